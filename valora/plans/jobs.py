"""The table jobs that use the column expressions: listings, questions, answers, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed, numeric, parse, render, rules


def enrich_listings(df: DataFrame, text: str = "text") -> DataFrame:
    """Typed attributes, flags and labels from the raw text of a listing, in one projection."""
    attrs = parse.extract_attrs(text)
    return df.select(
        *df.columns,
        *[c.alias(n) for n, c in attrs.items()],
        parse.days_listed(text).alias("days_listed"),
        parse.classify_type(text).alias("kind"),
        parse.is_owner(text).alias("is_owner"),
        parse.extract_phone(text).alias("phone"),
        parse.text_tags(text).alias("amenities"),
        parse.extract_floor(text).alias("floor"),
        rules.segment_by_text(text).alias("segment"),
    )


def parse_questions(df: DataFrame, text: str = "text", rich: bool = False) -> DataFrame:
    parsed = parse.parse_question_v2(text) if rich else parse.parse_question(text)
    return df.select(
        *df.columns, parse.is_on_topic(text).alias("on_topic"), *[c.alias(f"q_{n}") for n, c in parsed.items()]
    )


def parse_answers(df: DataFrame, text: str = "answer", profiles=tuple(fixed.ANSWER_PROFILES)) -> DataFrame:
    return df.select(*df.columns, *[parse.extract_price(text, p).alias(f"price_{p}") for p in profiles])


def render_rows(df: DataFrame, seed: int = 42, tags: str = "tags") -> DataFrame:
    """Question and worked example of each listing."""
    return df.select(
        *df.columns,
        render.question_text(seed, F.col(tags)).alias("pregunta"),
        render.example_messages(seed, F.col(tags)).alias("messages"),
    )


def validate_extraction(df: DataFrame, js: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clamp an extraction record to its allowed ranges; out of range or malformed gives NULL."""
    fields = [f"`{n}` STRING" for n in (*fixed.EXTRACTION_NUMBERS, *fixed.EXTRACTION_FLAGS, "notes")]
    parsed = df.withColumn("__j", F.from_json(js, "STRUCT<" + ", ".join(fields).replace(" STRING", ": STRING") + ">"))
    cols = []
    for name, (lo, hi, whole) in fixed.EXTRACTION_NUMBERS.items():
        v = F.col(f"__j.{name}").try_cast("double")
        ok = F.lit(True) if lo is None else v.between(lo, hi)
        v = F.when(ok, v)
        cols.append((v.cast("int") if whole else v).alias(name))
    for name in fixed.EXTRACTION_FLAGS:
        raw = F.lower(F.col(f"__j.{name}"))
        cols.append(F.when(raw.isNull(), None).when(raw.isin("false", "0", ""), 0).otherwise(1).cast("int").alias(name))
    cols.append(F.substring(F.coalesce(F.col("__j.notes"), F.lit("")), 1, 200).alias("notes"))
    return parsed.select(*keep, *cols)


def unwrap_batch(df: DataFrame, raw: str, size: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per expected item of a batch reply: a list, a list under a known key, or one object;
    short replies are padded with empty objects."""
    item = "ARRAY<STRING>"
    body = F.trim(F.col(raw))
    as_list = F.when(body.startswith("["), F.from_json(body, item))
    under = [F.from_json(F.get_json_object(body, f"$.{k}"), item) for k in fixed.BATCH_KEYS]
    single = F.when((F.col(size) == 1) & body.startswith("{"), F.array(body))
    got = F.coalesce(as_list, *under, single, F.array().cast(item))
    rows = df.withColumn("__got", got).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col(size) - 1)))
    return rows.select(*keep, "pos", F.coalesce(F.get("__got", F.col("pos")), F.lit("{}")).alias("item"))


def price_metrics(df: DataFrame) -> DataFrame:
    low, high = numeric.price_range("price")
    return df.withColumn("low", low).withColumn("high", high)
