"""A table of questions to valuations: parse, features, price, comparables, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import fixed
from valora.operators import retrieve
from valora.operators.models import PriceModel, params_to_features
from valora.session import materialize


def value_questions(parsed: DataFrame, model: PriceModel, encoder: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """``parsed`` comes from ``parse_questions`` (with qid and text); questions off topic are dropped.

    ``pool`` has id, colonia, municipio, recamaras, m2, price, amueblado, lujo.
    """
    asked = parsed.filter("on_topic").drop("on_topic")
    feats = params_to_features(asked, encoder, fuzzy=True)
    priced = materialize(model.score(feats).select("qid", "text", "estimate", F.col("colonia").alias("q_zone"), "m2", "recamaras"), "priced")
    q = priced.select("qid", F.col("q_zone").alias("colonia"), F.lit(None).cast("string").alias("municipio"), "recamaras", "m2", F.col("estimate").alias("anchor"))
    hits = retrieve.similar(q, pool, k, anchored=True, ignore_case=True)
    cards = pool.select("id", "colonia", "m2", "recamaras", "amueblado", "lujo", "price")
    block = retrieve.format_examples(hits.join(cards, "id"), "qid")
    return retrieve.context_prompt(priced.join(block, "qid"), "text", "examples", F.lit(fixed.EXAMPLE_SYSTEM), "estimate")
