"""Joins of the listing domain. Sides are never forced to broadcast: the measured size decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.operators.quantile import attach
from valora.session import materialize


def attach_contacts(listings: DataFrame, contacts: DataFrame, key: str = "source_url") -> DataFrame:
    return listings.join(contacts, key, "left")


def with_anchor(preds: DataFrame, anchors: DataFrame, default: float, key: str = "id") -> DataFrame:
    """Anchor price per question, a constant where there is none."""
    got = preds.join(anchors.select(key, "anchor"), key, "left")
    return got.withColumn("anchor", F.coalesce(F.col("anchor"), F.lit(default)))


def align(preds: DataFrame, a: str, b: str, value: str, key: str = "id", model: str = "model") -> DataFrame:
    """One row per question with both models' values; questions either lacks are dropped."""
    one = lambda m, name: preds.filter(F.col(model) == m).select(key, F.col(value).alias(name))
    return one(a, "a").join(one(b, "b"), key).filter("a IS NOT NULL AND b IS NOT NULL")


def aligned_counts_match(preds: DataFrame, a: str, b: str, value: str, model: str = "model") -> bool:
    """Whether both models have the same number of values (one small aggregate)."""
    row = preds.agg(
        F.count_if((F.col(model) == a) & F.col(value).isNotNull()).alias("a"),
        F.count_if((F.col(model) == b) & F.col(value).isNotNull()).alias("b"),
    ).first()
    return row["a"] == row["b"]


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not processed yet."""
    return df.join(done.select(key), key, "left_anti")


def answered_by_all(preds: DataFrame, models: Sequence[str], value: str, key: str = "id", model: str = "model") -> DataFrame:
    """Ids that every one of the models answered."""
    ok = preds.filter(F.col(value).isNotNull() & F.col(model).isin(list(models)))
    return ok.groupBy(key).agg(F.count_distinct(model).alias("m")).filter(F.col("m") == len(models)).select(key)


def backfill(df: DataFrame, source: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing columns from a keyed table."""
    src = source.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    got = df.join(src, key, "left")
    return got.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def expand_grid(df: DataFrame, models: Sequence[str], configs: Sequence[str]) -> DataFrame:
    """Every question for every model and configuration: a generator over constants, not a join."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(cfg).alias("config")) for m in models for cfg in configs
    ])
    return df.select("*", F.explode(cells).alias("__c")).select(*df.columns, "__c.model", "__c.config")


def _grams(text: Column) -> Column:
    """Distinct substrings of up to three characters."""
    def of(n: int) -> Column:
        return F.transform(
            F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(text, i, F.lit(n)),
        )

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _query_grams(text: Column) -> Column:
    """The longest grams (up to three characters) of a query: all must occur in a key containing it."""
    n = F.least(F.length(text), F.lit(3))
    return F.array_distinct(F.transform(
        F.when(n > 0, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(text, i, n),
    ))


def resolve_category(df: DataFrame, encoder: DataFrame, query: str, default: Column | None = None) -> DataFrame:
    """Encoder value for a free-text category.

    In order: exact key, Title Case, Capitalised, the alphabetically first key that contains the
    query (case ignored), the global mean. Containment is found through an index of three-letter
    pieces: a query joins only the keys that share its rarest piece, and is then verified.
    """
    enc = materialize(encoder.select("key", "enc", "global_mean"), "encoder")
    fallback = enc.agg(F.max("global_mean")).scalar() if default is None else default
    asked = materialize(df.select(F.coalesce(F.col(query), F.lit("")).alias("__q")).distinct(), "asked")
    low = F.lower("__q")
    cap = F.concat(F.upper(F.substring("__q", 1, 1)), F.lower(F.expr("substring(__q, 2)")))
    forms = asked.select("__q", F.posexplode(F.array(F.col("__q"), F.initcap("__q"), cap)).alias("rank", "key"))
    direct = forms.join(enc.select("key", "enc"), "key").groupBy("__q").agg(F.min_by("enc", "rank").alias("enc"))

    rest = asked.join(direct, "__q", "left_anti")
    keys = enc.select("key", "enc", F.lower("key").alias("kl"))
    index = keys.select("key", "enc", "kl", F.explode(_grams(F.col("kl"))).alias("g"))
    rarity = index.groupBy("g").agg(F.count("*").alias("df"))
    pieces = rest.filter("__q <> ''").select("__q", low.alias("ql"), F.explode(_query_grams(low)).alias("g"))
    rarest = pieces.join(rarity, "g").groupBy("__q", "ql").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    inside = (
        rarest.join(index, "g")
        .filter(F.contains("kl", "ql"))
        .groupBy("__q").agg(F.min_by("enc", "key").alias("enc"))
    )
    # An empty query is contained in every key: the first one answers it.
    empty = rest.filter("__q = ''").select("__q", enc.agg(F.min_by("enc", "key")).scalar().alias("enc"))
    found = direct.unionByName(inside).unionByName(empty)
    got = df.withColumn("__q", F.coalesce(F.col(query), F.lit("")))
    got = attach(got, found.withColumnRenamed("enc", "__enc"), ["__q"])
    return got.withColumn(f"{query}_enc", F.coalesce(F.col("__enc"), fallback)).drop("__q", "__enc")
