"""Best-fit packing of documents into sequences under several capacities at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty
from valora.llm.tokens import encoder

DIMENSIONS = ("tokens", "documents", "attention")
LEVELS = 63  # times that open bins are dealt anew; beyond, they stay as they are


def cut_documents(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit integers).

    A document is its token ids and ``end_id``. Only longer ones than ``limit`` are cut: all pieces but the
    first, which takes the remainder, are full. A null text counts as empty: one piece of one id. Null ids
    and repeated rows pass like any other. Other columns are ignored.
    """

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids:binary>>")
    def pieces(texts: pd.Series) -> pd.Series:
        tail, out = np.array([end_id], dtype="<u4").tobytes(), []
        for raw in encoder(tokenizer_path).encode(list(texts)):
            raw += tail
            n = len(raw) // 4
            cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
            out.append([{"piece": k, "start": i, "length": j - i, "ids": raw[4 * i:4 * j]} for k, (i, j) in enumerate(zip(cuts, cuts[1:]))])
        return pd.Series(out)

    return docs.select(F.col(id_col).alias(id_col), F.explode(pieces(text_or_empty(text_col))).alias("p")).select(id_col, "p.*")


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the open bin that suits it best.

    An item asks for (length, 1, length squared). Of the bins where every residual capacity suffices, it takes
    the one of the smallest weighted residual norm, or of the largest weighted dot product of residual
    and demand (``rule="dot"``); equal scores go to the older bin.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    left, used, ids = np.empty((n, 3)), np.empty(n, np.int64), np.empty(n, np.int64)
    n_open = n_bins = 0
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        ask = np.array([size, 1.0, float(size) * size]) / capacity
        residual = left[:n_open]
        ok = np.nonzero((residual >= ask - 1e-12).all(axis=1))[0]
        if len(ok):
            if rule == "dot":
                score = -(residual[ok] * (weights * ask)).sum(axis=1)
            else:
                score = (weights * (residual[ok] - ask) ** 2).sum(axis=1)
            k = ok[score.argmin()]
        else:
            k, n_open = n_open, n_open + 1
            left[k], used[k], ids[k] = 1.0, 0, n_bins
            n_bins += 1
        bins[at], offsets[at] = ids[k], used[k]
        left[k] -= ask
        used[k] += size
        if (left[k, :2] * capacity[:2] < 0.5).any():  # full: no longer looked at
            n_open -= 1
            left[k:n_open], used[k:n_open], ids[k:n_open] = left[k + 1:n_open + 1].copy(), used[k + 1:n_open + 1].copy(), ids[k + 1:n_open + 1].copy()
    return bins, offsets


def pack_pieces(
    pieces: DataFrame, limit: int = 2048, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm", group_rows: int = 8192,
) -> DataFrame:
    """``pieces`` (with length <= limit) and their sequence_id and offset.

    Capacities of a sequence: ``limit`` tokens, ``max_documents`` pieces, ``max_attention`` summed squared
    lengths; the last two default to what ``limit`` implies. Pieces are dealt at random to groups of about
    ``group_rows``, each packed on its own; the bins a group leaves with room are opened and dealt anew to
    fewer groups, until one group is left. Every piece is placed exactly once, repeated rows too.
    """
    max_documents, max_attention = max_documents or limit, max_attention or limit * limit
    capacity, weight = np.array([limit, max_documents, max_attention], dtype=float), np.array(weights)
    rows = materialize(pieces, "pieces").withColumn("_row", F.monotonically_increasing_id())
    alone = (F.col("length") >= limit) | (F.col("length") * F.col("length") >= max_attention) | F.lit(max_documents == 1)
    placed = [rows.where(alone).withColumn("sequence_id", F.col("_row") * 64 + 63).withColumn("offset", F.lit(0).cast("long"))]
    open_rows, kept = rows.where(~alone).select("_row", "length"), []
    for level in range(LEVELS):
        n = open_rows.count()
        groups = max(1, -(-n // group_rows))

        def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "_row"], ascending=[False, True])
            bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, weight, rule)
            total = np.bincount(bins, weights=pdf["length"].to_numpy())
            return pd.DataFrame({
                "_row": pdf["_row"], "length": pdf["length"], "sequence_id": (key[0] * (1 << 32) + bins) * 64 + level, "offset": offsets,
                "room": limit - total[bins] >= 1,
            })

        dealt = open_rows.withColumn("g", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
        done = materialize(dealt.groupBy("g").applyInPandas(place, "_row long, length long, sequence_id long, offset long, room boolean"), "placed")
        if groups == 1 or level == LEVELS - 1:
            kept.append(done)
            break
        kept.append(done.where("not room"))
        again = done.where("room").select("_row", "length")
        if again.count() > 0.9 * n:  # hardly a bin is full: these sizes do not fit together any better
            kept.append(done.where("room"))
            break
        open_rows = again
    spots = kept[0]
    for more in kept[1:]:
        spots = spots.unionByName(more)
    placed.append(rows.join(spots.select("_row", "sequence_id", "offset"), "_row"))
    return placed[0].unionByName(placed[1]).drop("_row")
