"""Document quality from a classifier and from the site a document stands on, by hierarchical empirical Bayes.

A logistic model on measures of the text gives the evidence of each document. Sites have two levels, host
and path. The mean evidence of a host is shrunk towards that of all documents, the mean of a path towards
its host's; how strongly follows from how much the levels below differ beyond chance. A document's
posterior log-odds are its own plus those by which its path, without it, differs from all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty
from valora.llm.tokens import forget

SYMBOLS = "*%$&#|!"  # counted one by one
UPPER, DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
N_MEASURES = 14 + len(SYMBOLS)


def measures(text: str) -> list[float]:
    """Measures of one whole text: size, variety, repetition, letter classes, symbols."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars, raw = max(1, len(words)), max(1, len(text)), text.encode()
    again = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    letters, digits = len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, DIGITS))
    scale = lambda x: float(np.log1p(200.0 * x))
    return [
        float(np.log1p(len(words))), len(set(words)) / n, scale(again / n), len(set(lines)) / max(1, len(lines)), scale(letters / chars),
        letters / chars, scale(digits / chars), len(text) / n, scale(text.count(".") / n), scale(text.count(",") / n), scale(text.count("\n") / n),
        scale(max(0.0, len(raw) / chars - 1)), float(len(words) < 5), min(1.0, max(map(len, words), default=0) / 100),
        *[scale(text.count(c) / chars) for c in SYMBOLS],
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, np.ndarray]:
    """Bias and weights for raw measures, by Newton steps on standardised ones and their squares."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    z = (x - mean) / sd
    a = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - (w[1:] / sd * mean).sum()), w[1:] / sd


def _squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x], axis=1)


def train_evidence(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str):
    """The model from at most ``sample_rows`` labelled documents, taken by a hash of their ids."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([measures(t) for t in texts])

    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y")).where("y in (0, 1)")
    chosen = materialize(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "labelled")
    joined = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(chosen, "id")
    rows = joined.select("id", "y", measured("text").alias("m")).dropDuplicates(["id"]).orderBy("id").limit(sample_rows).collect()
    if not rows or len({r.y for r in rows}) < 2:  # nothing to learn from: all documents are alike
        return 0.0, np.zeros(2 * N_MEASURES)
    return fit_logistic(_squares(np.array([r.m for r in rows])), np.array([r.y for r in rows]))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, size: str, parent: str) -> float:
    """How many documents a parent's mean is worth: from the variance of the group means beyond chance."""
    within = F.col(parent) * (1 - F.col(parent)) / F.col(size)
    row = groups.where(F.col(size) > 1).agg(
        F.sum(F.col(size)).alias("n"), F.sum(F.col(size) * (F.pow(F.col(mean) - F.col(parent), 2) - within)).alias("between"),
        F.sum(F.col(size) * F.col(parent) * (1 - F.col(parent))).alias("spread"),
    ).first()
    if not row.n or row.between <= 0:
        return 1e6
    return float(min(1e6, max(1.0, row.spread / row.between - 1)))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", sample_rows: int = 20_000, least: float = 0.5, clip: float = 8.0,
) -> DataFrame:
    """``docs`` with _evidence (log-odds of the text), _host, _path (posterior means), _score and _keep.

    ``labels`` (id, label 0 or 1) train the text model on at most ``sample_rows`` of them; sites are measured over
    all documents. Labels that are null or contradict each other are left out; with none or only one kind of
    label every document has evidence 0. ``_keep`` is ``_score >= least``. A null text counts as empty, a null
    host or path is a site of its own, null ids and repeated rows are scored like any other row. All columns
    pass through; those of the five names above are replaced.
    """
    bias, weights = train_evidence(docs, labels, sample_rows, id_col, text_col, label_col)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        forget()
        x = _squares(np.array([measures(t) for t in texts]).reshape(-1, N_MEASURES))
        return pd.Series(np.clip(bias + x @ weights, -clip, clip))

    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    names = ["_evidence", "_host", "_path", "_score", "_keep"]
    rows = docs.drop(*names).withColumns({"_evidence": evidence(text_or_empty(text_col)), "__h": site(host_col), "__p": site(path_col)})
    good = 1 / (1 + F.exp(-F.col("_evidence")))
    paths = materialize(rows.groupBy("__h", "__p").agg(F.count("*").alias("__n"), F.sum(good).alias("__s")), "sites")
    total = paths.agg(F.sum("__n").alias("n"), F.sum("__s").alias("s")).first()
    overall = min(1 - 1e-6, max(1e-6, total.s / total.n)) if total.n else 0.5
    hosts = paths.groupBy("__h").agg(F.sum("__n").alias("hn"), F.sum("__s").alias("hs")).withColumn("overall", F.lit(overall))
    hosts = materialize(hosts.withColumn("mean", F.col("hs") / F.col("hn")), "sites")
    host_strength = _strength(hosts, "mean", "hn", "overall")
    hosts = hosts.select("__h", ((F.col("hs") + host_strength * F.lit(overall)) / (F.col("hn") + host_strength)).alias("_host"))
    both = materialize(paths.join(hosts, "__h").withColumn("mean", F.col("__s") / F.col("__n")), "sites")
    path_strength = _strength(both, "mean", "__n", "_host")
    joined = rows.join(both.select("__h", "__p", "__n", "__s", "_host"), ["__h", "__p"])
    path = (F.col("__s") + path_strength * F.col("_host")) / (F.col("__n") + path_strength)
    others = (F.greatest(F.col("__s") - good, F.lit(0.0)) + path_strength * F.col("_host")) / (F.col("__n") - 1 + path_strength)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("_evidence") + logit(others) - float(np.log(overall / (1 - overall)))
    scored = joined.withColumns({"_path": path, "_score": 1 / (1 + F.exp(-odds))}).withColumn("_keep", F.col("_score") >= least)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *names)
