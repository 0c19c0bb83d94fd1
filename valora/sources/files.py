"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.functions.parse import label
from valora.functions.rules import PROFILES, score

LISTING_RAW = (
    "name STRING, phone STRING, email STRING, address STRING, colonia STRING, price DOUBLE, operation_type STRING, "
    "property_type STRING, bedrooms INT, bathrooms DOUBLE, parking INT, area_m2 DOUBLE, terrain_m2 DOUBLE, floor INT, "
    "age_years INT, furnished INT, has_pool INT, has_gym INT, description STRING, is_owner BOOLEAN, score INT, "
    "source_url STRING, scraped_at TIMESTAMP, source STRING"
)
QUESTION = (
    "id STRING, tipo STRING, pregunta STRING, precio_real DOUBLE, colonia STRING, municipio STRING, recamaras DOUBLE, "
    "m2 DOUBLE, amueblado INT, lujo INT, split STRING"
)
PREDICTION = (
    "id STRING, precio_real DOUBLE, precio_xgb DOUBLE, precio_predicho DOUBLE, respuesta_raw STRING, error_pct DOUBLE, "
    "modelo STRING, config STRING"
)


def read_listings_csv(spark: SparkSession, path: str, schema: str = LISTING_RAW) -> DataFrame:
    """CSV with header and quoted multi-line text."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_poi_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Latin-1 points of interest: three of the columns, coordinates coerced, unusable rows dropped."""
    # Without a schema every column is read as a string from the header alone, so no inference pass.
    raw = spark.read.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    return raw.select(
        "nombre_act",
        F.col("latitud").try_cast("double").alias("latitud"),
        F.col("longitud").try_cast("double").alias("longitud"),
    ).dropna(subset=["latitud", "longitud"])


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_questions(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that are one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines ``Iter n: Train loss x`` / ``Iter n: Val loss x`` to (iter, series, loss)."""
    lines = spark.read.text(path)
    pattern = r"Iter (\d+): (Train|Val) loss ([\d.]+)"
    return lines.filter(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("bigint").alias("iter"),
        F.lower(F.regexp_extract("value", pattern, 2)).alias("series"),
        F.regexp_extract("value", pattern, 3).try_cast("double").alias("loss"),
    )


def write_csv(df: DataFrame, cols: Sequence[str], path: str) -> None:
    df.select(*cols).write.option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.partitionBy(by).json(path)


def write_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Append one metrics record of a run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").json(path)


def slice_rows(df: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """One row per (row, slice it belongs to), in a single pass; slices may overlap."""
    marks = F.array(*[F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in slices.items()])
    return df.withColumn("slice", F.explode(F.filter(marks, lambda x: x.isNotNull())))


def write_slices(df: DataFrame, slices: Mapping[str, Column], path: str) -> None:
    slice_rows(df, slices).write.partitionBy("slice").parquet(path)


def save_encoders(encoders: DataFrame, path: str) -> None:
    encoders.write.mode("overwrite").parquet(path)


def load_encoders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lead_cards(df: DataFrame, amenities: Mapping[str, str]) -> DataFrame:
    """Compact lead record: labels, amenity array, cut texts, defaults; plus its JSON form."""
    def text(name: str, size: int, default: str) -> Column:
        return F.coalesce(F.substring(F.col(name), 1, size), F.lit(default)).alias(name)

    card = df.select(
        F.col("listing_id"),
        text("name", 60, "Sin nombre"),
        F.coalesce(F.col("phone"), F.lit("")).alias("phone"),
        F.coalesce(F.col("source_url"), F.lit("")).alias("url"),
        label(F.col("property_type"), fixed.TYPE_LABELS, "Otro").alias("type"),
        F.coalesce(F.floor("price"), F.lit(0)).cast("bigint").alias("price"),
        text("colonia", 35, ""),
        F.floor("area_m2").cast("bigint").alias("m2"),
        F.col("bedrooms").alias("beds"),
        F.coalesce(F.col("furnished") == 1, F.lit(False)).cast("int").alias("furnished"),
        F.filter(
            F.array(*[F.when(F.col(c) == 1, F.lit(name)) for c, name in amenities.items()]),
            lambda x: x.isNotNull(),
        ).alias("amenities"),
        text("notes", 100, ""),
        *[score(rules).alias(f"score_{name}") for name, rules in PROFILES.items()],
    )
    return card.withColumn("card", F.to_json(F.struct(*[c for c in card.columns if c != "listing_id"])))
