"""Resampling of documents towards a target by hashed n-grams of words.

Each document is read once: its words, joined by single blanks, go through one running CRC-32 whose values before
and behind every word are kept. The CRC of any run of words follows from two of them: with ``a`` what stands
before the run and ``b`` the run, ``crc(ab) = shift(crc(a), len(b)) ^ crc(b)``, where the shift by a number
of zero bytes is linear over GF(2) and read from tables, one for each base-256 digit of the number.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty
from valora.operators.ordering import numbered

# Bytes of a lower-cased text that are ASCII, but neither digits nor letters, stand between words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
POLYNOMIAL = 0xEDB88320
PIECE = 1 << 20  # bytes of a text whose words are listed at a time
STEP = 1 << 19  # words whose runs are hashed at a time
CHARS = 1 << 22  # characters of the texts that are hashed together


def _zero_byte(state: np.ndarray) -> np.ndarray:
    """The CRC register after one more zero byte."""
    low = state & np.uint32(255)
    for _ in range(8):
        low = np.where(low & 1, (low >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), low >> np.uint32(1))
    return low ^ (state >> np.uint32(8))


@cache
def shift_table(level: int) -> np.ndarray:
    """[digit, k, byte]: the register ``byte << 8k`` after ``digit * 256**level`` zero bytes."""
    state = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    rows = [state]
    for _ in range(255):
        state = _one_step(state, level)
        rows.append(state)
    return np.stack(rows)


def _one_step(state: np.ndarray, level: int) -> np.ndarray:
    if level == 0:
        return _zero_byte(state)
    return _one_step(_look_up(shift_table(level - 1)[255], state), level - 1)


def _look_up(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = table[0][state & 255]
    for k in (1, 2, 3):
        out = out ^ table[k][(state >> np.uint32(8 * k)) & 255]
    return out


def shift_crc(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """``state`` after ``zeros`` zero bytes, element by element."""
    level, rest, out = 0, zeros, state
    while len(rest) and rest.max() > 0:
        digit, table = rest & 255, shift_table(level).reshape(-1)
        base, moved = digit << 10, None
        for k in range(4):
            part = table[base + (k << 8) + ((out >> np.uint32(8 * k)) & 255)]
            moved = part if moved is None else moved ^ part
        out, rest, level = moved, rest >> 8, level + 1
    return out


def running_crcs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CRC before and behind each word of the normalised texts, the words' sizes, and the number of words of each text."""
    marks, sizes, counts = array("I"), array("I"), []
    for text in texts:
        raw = text.encode("utf-8", "replace").lower()
        crc = at = n = 0
        while at < len(raw):
            cut = GAP.search(raw, at + PIECE)
            end = cut.end() if cut else len(raw)
            words = WORD.findall(raw, at, end)
            for word in words:
                marks.append(crc)
                crc = crc32(word, crc)
                marks.append(crc)
                crc = crc32(b" ", crc)
            sizes.extend(map(len, words))
            n, at = n + len(words), end
        counts.append(n)
    both = np.frombuffer(marks, dtype=np.uint32).reshape(-1, 2) if marks else np.zeros((0, 2), np.uint32)
    return both[:, 0], both[:, 1], np.array(sizes, dtype=np.int64), np.array(counts, dtype=np.int64)


def feature_buckets(texts: list[str], orders: int, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of words of each text, and the buckets of all its runs of 1 to ``orders`` words as little-endian integers."""
    starts, ends, sizes, counts = running_crcs(texts)
    last = np.cumsum(sizes + 1)  # texts follow each other; only differences inside one count
    first = last - sizes
    text_of = np.repeat(np.arange(len(texts)), counts)
    kind = id_type(buckets)
    parts: list[list[bytes]] = [[] for _ in texts]
    for order in range(1, orders + 1):
        found = [np.zeros(0, kind)]
        for lo in range(0, len(sizes) - order + 1, STEP):
            i = np.arange(lo, min(lo + STEP, len(sizes) - order + 1))
            i = i[text_of[i] == text_of[i + order - 1]]
            j = i + order - 1
            found.append((ends[j] ^ shift_crc(starts[i], last[j] - first[i])) % np.uint32(buckets))
        flat = np.concatenate([x.astype(kind) for x in found])
        cuts = np.concatenate([[0], np.cumsum(np.maximum(counts - order + 1, 0))]) * kind.itemsize
        raw = flat.tobytes()
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            parts[k].append(raw[a:b])
    return counts, [b"".join(p) for p in parts]


def id_type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def hashed_ngrams(docs: DataFrame, keep: list[Column], text_col: str, orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """``keep``, n_words and features (the buckets as binary) of every row; a null text has no words."""

    def read(batches):
        for batch in batches:
            texts, at = batch.column("__text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHARS):
                    size += len(texts[end])
                    end += 1
                counts, features = feature_buckets(texts[at:end], orders, buckets)
                part = batch.slice(at, end - at)
                columns = [part.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts), pa.array(features, pa.binary())], names=[*batch.schema.names[:-1], "n_words", "features"])
                at = end

    rows = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(read, f"{kept}{', ' if kept else ''}n_words long, features binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; each task sends one row a bucket."""

    def count(batches):
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                seen += np.bincount(np.frombuffer(raw.as_buffer(), dtype=id_type(buckets)), minlength=buckets)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[at])], names=["bucket", "n"])

    found = hashed.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    gain = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
    return np.array([gain(s, t) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 g) of a Gumbel draw from the hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, orders: int = 3, buckets: int = 10_000, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank.

    Features are all runs of 1 to ``orders`` words, hashed into ``buckets`` by CRC-32; the weight of a document
    is the sum of its features' gains towards ``target``. Of the documents of at least ``least_words`` words,
    ``percent`` hundredths are drawn without replacement, by weight plus Gumbel noise of the id; they get ranks
    1, 2, 3 ... by descending score, ties to the smaller id, the others null. Null and empty texts have no features
    and weight 0, and count in no statistic. Rows with a null id count in the statistics, but have no score and
    are never drawn. Repeated rows count one by one. An empty target gives every bucket its smoothed gain. Other
    columns are ignored.
    """
    hashed = materialize(hashed_ngrams(docs, [F.col(id_col).alias("id")], text_col, orders, buckets), "ngrams")
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(hashed_ngrams(target, [], target_col, orders, buckets), buckets))

    def weigh(batches):
        for batch in batches:
            raws = batch.column("features")
            weights = [int(gains[np.frombuffer(raw.as_buffer(), dtype=id_type(buckets))].sum()) for raw in raws]
            sizes = [len(raw.as_buffer()) // id_type(buckets).itemsize for raw in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())],
                names=["id", "n_words", "n_features", "weight"])

    kind = hashed.schema["id"].dataType.simpleString()
    weighed = hashed.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel("id", seed))
    scored = materialize(scored.withColumn("out", F.col("id").isNull() | (F.col("n_words") < least_words)), "scored")
    drawn = scored.where("not out").count() * percent // 100
    ranked = numbered(scored, [], [F.col("out"), -F.col("score"), F.col("id")], "place")
    return ranked.select(
        F.col("id").alias(id_col), "n_features", "weight", "score", F.when(~F.col("out") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
