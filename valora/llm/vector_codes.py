"""Short codes of vectors: the nearest codebook entry of each part, all in exact integers.

Components are integers. Dot products run as float64 matrix products of limbs so narrow that no sum of
products reaches 2**53; the limbs' products are put together in int64, so distances are exact and the first of
equally near entries is always the same one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize


def split_limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """float64 limbs, the lowest first: ``values`` is the sum of ``limb[i] << (i * width)``; only the last has a sign."""
    out, rest = [], values
    while rest.size and (rest.max() >= 1 << width or rest.min() < -(1 << width)):
        out.append((rest & ((1 << width) - 1)).astype(np.float64))
        rest = rest >> width
    return [*out, rest.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the last axes of int64 arrays (..., n, d) and (..., m, d): exact where they fit 64 bits."""
    width = (53 - math.ceil(math.log2(max(a.shape[-1], 1)))) // 2
    out = np.zeros((*a.shape[:-1], b.shape[-2]), dtype=np.int64)
    right = [y.swapaxes(-1, -2) for y in split_limbs(b, width)]
    for i, x in enumerate(split_limbs(a, width)):
        for j, y in enumerate(right):
            if width * (i + j) < 64:  # higher ones are multiples of 2**64
                out += (x @ y).astype(np.int64) << (width * (i + j))
    return out


def nearest_entries(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry and squared distance, both (rows, parts), of ``values`` (rows, parts, d) in ``books`` (parts, entries, d)."""
    x = values.transpose(1, 0, 2)
    far = (books * books).sum(axis=2)[:, None, :] - 2 * exact_products(x, books)
    code = far.argmin(axis=2)
    least = np.take_along_axis(far, code[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)
    return code.T, least.T


def whole_parts(vectors: pa.Array, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component as int64, (rows, parts, d)."""
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = flat.reshape(len(vectors), parts, -1)
    # Twice this bound, squared and summed over a part, still fits 64 bits.
    bound = math.isqrt((1 << 61) // max(1, out.shape[2])) - 1
    if flat.size and np.abs(flat).max() > bound:
        raise ValueError(f"components beyond {bound / scale:g} have no exact 64-bit distance")
    return out.astype(np.int64)


def encode_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per usable vector: id, code (two hex digits per part), error, label_error, codebooks_sha256.

    Components become floor(``scale`` * x). Each part position starts from the ``entries`` smallest ids (of an id
    with several vectors, the smallest vector); each round moves every entry to the floor of its parts' mean;
    entries without parts stay. Vectors that are null or hold null or non-finite components are dropped. Codes are
    made for vectors of the most frequent length that ``parts`` divides; those of other lengths, empty ones
    too, keep their row with a null code and error. Rows with a null id are coded but start no entry; repeated
    rows count one by one. ``label_error`` sums over equal labels, null ones together. An empty table gives no
    rows. A component too large for exact 64-bit distances fails the job. Only the codebooks, of fixed size, and
    their sums pass through the driver. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = rows.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = good.groupBy(F.size("vec").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    top = lengths.orderBy(F.desc("count"), "n").first()
    length = top.n if top else -1
    fits = good.where(F.size("vec") == length)
    ids = [r.id for r in fits.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    seeds = fits.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect() if ids else []
    if not seeds and top:  # no row has an id: the smallest vectors start
        seeds = fits.select("vec").distinct().orderBy("vec").limit(entries).collect()
    start = pa.array([r.vec for r in seeds], pa.list_(pa.float64()))
    books = whole_parts(start, parts, scale).transpose(1, 0, 2).copy() if seeds else np.zeros((parts, 0, 0), np.int64)
    for _ in range(rounds if seeds else 0):
        books = _moved(fits.select("vec"), books, scale)
    text = ",".join(map(str, books.reshape(-1).tolist()))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                code, far = nearest_entries(whole_parts(batch.column("vec"), parts, scale), books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code.astype(np.uint8)]), pa.array(far.sum(axis=1))],
                    names=["id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {good.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    coded = fits.mapInArrow(code, f"{kinds}, code string, error long")
    odd = good.where(F.size("vec") != length).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialize(coded.unionByName(odd), "codes")
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _moved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round; each task sends its sums and counts by part, entry and position."""
    parts, entries, d = books.shape
    slots = parts * entries * (d + 1)

    def add(batches):
        seen = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                values = whole_parts(batch.column("vec"), parts, scale)
                code, _ = nearest_entries(values, books)
                entry = np.arange(parts) * entries + code
                wide = np.concatenate([values, np.ones((*code.shape, 1), np.int64)], axis=2)
                np.add.at(seen.reshape(-1, d + 1), entry.reshape(-1), wide.reshape(-1, d + 1))
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[at])], names=["slot", "n"])

    sums = np.zeros(slots, dtype=np.int64)
    for r in vectors.mapInArrow(add, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        sums[r.slot] = r.n
    sums = sums.reshape(parts, entries, d + 1)
    count = sums[:, :, d:]
    return np.where(count > 0, sums[:, :, :d] // np.maximum(count, 1), books)
