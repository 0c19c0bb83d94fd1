"""Removal of repeated passages, found as equal runs of consecutive sentences."""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty

SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|\n|$)\s*", re.S)
CHUNK = re.compile(r"\S+\s*")
# Bits of a run's place: known to be repeated, long from a word on, long up to a word, that word.
SURE, LONG, UP_TO, WORD = 1 << 31, 1 << 30, 1 << 29, (1 << 29) - 1


def sentences(text: str) -> list[str]:
    """The text in pieces that end behind [.!?] and white space or behind a line; joined they are the text."""
    return [s for s in SENTENCE.findall(text) if s]


class Runs:
    """The runs of one text as spans of words.

    Sentences end as in :func:`sentences`. Runs of ``size`` sentences with at least ``least_words`` words start at
    every sentence. Long runs start at every piece: sentences are cut further in front of words whose hash
    is a multiple of ``cut``, which depends on the words alone, so that copies are cut alike wherever they
    stand; a long run is the shortest row of pieces with ``long_words`` words from a piece on, or up to the
    end of a sentence, so that also the end of a passage of whole sentences lies in one.
    """

    def __init__(self, text: str, size: int | None, least_words: int, long_words: int | None, cut: int):
        self.chunks = CHUNK.findall(text)
        self.words = [w.encode() for w in text.lower().split()]
        n = len(self.words)
        if n > WORD:
            raise ValueError(f"a text of more than {WORD} words")
        ends = np.fromiter((w[-1] in b".!?" for w in self.words), bool, n) | np.fromiter(("\n" in c for c in self.chunks), bool, n)
        begins = np.ones(n, bool)
        begins[1:] = ends[:-1]
        self.sentence = np.cumsum(begins) - 1
        self.spans: list[tuple[int, int, int]] = []  # place, first word, end
        if size:
            edges = np.append(np.flatnonzero(begins), n)
            first, last = edges[:-size], edges[size:]
            keep = last - first >= least_words
            self.spans += [(a, a, b) for a, b in zip(first[keep].tolist(), last[keep].tolist())]
        if long_words and n >= long_words:
            ends = np.append(np.flatnonzero(begins)[1:], n)
            begins = begins | (np.fromiter(map(crc32, self.words), np.uint32, n) % np.uint32(cut) == 0)
            edges = np.append(np.flatnonzero(begins), n)
            at = np.searchsorted(edges, edges[:-1] + long_words)
            keep = at < len(edges)
            last = dict(zip(edges[:-1][keep].tolist(), edges[at[keep]].tolist()))
            self.spans += [(LONG | a, a, b) for a, b in last.items()]
            ends = ends[ends >= long_words]
            first = edges[np.searchsorted(edges, ends - long_words, side="right") - 1]
            self.spans += [(UP_TO | b, a, b) for a, b in zip(first.tolist(), ends.tolist()) if last.get(a) != b]

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64 bits and 32 more of each run's hash, and its place."""
        found = [hashlib.blake2b(b"\0".join(self.words[a:b]), digest_size=12, person=b"" if place == a else b"long").digest() for place, a, b in self.spans]
        raw = np.frombuffer(b"".join(found), dtype=[("key", "<i8"), ("check", "<u4")])
        return raw["key"], raw["check"].astype(np.int64), np.array([place for place, _, _ in self.spans], dtype=np.int64)

    def without(self, places: list[int], text: str) -> tuple[str, int]:
        """The text without the runs at ``places``, and the number of sentences that lost words."""
        wanted, gone = set(places), np.zeros(len(self.words), bool)
        for place, a, b in self.spans:
            if place in wanted:
                gone[a:b] = True
        if not gone.any():
            return text, 0
        head = "" if gone[0] else text[:len(text) - len(text.lstrip())]
        return head + "".join(c for c, g in zip(self.chunks, gone.tolist()) if not g), len(np.unique(self.sentence[gone]))


def _first_of_equal(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For sorted rows, the index of the first row with the same hash."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def drop_repeated_passages(
    docs: DataFrame, size: int | None = 3, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = None, cut: int = 4,
) -> DataFrame:
    """``docs`` with repeated passages taken out of the text, and n_removed, the number of sentences that lost words.

    Every run of ``size`` consecutive sentences that holds at least ``least_words`` words is hashed (none where
    ``size`` is None), and with ``long_words`` every long run (see :class:`Runs`), be it part of a sentence or
    many sentences; case and white space do not count. Of equal runs the one of the smallest (id, position)
    stays, and the words of all others go, wherever they stand. Null and empty texts, and texts shorter than a
    run, come back unchanged. Rows with equal ids count as one document: repeated rows are treated alike. Rows
    with a null id come back unchanged and make nothing go. All other columns pass through. Each batch of texts
    sends one row per distinct run, so that a run that many documents hold stays small; hashes have 96 bits.
    """
    rule = (size, least_words, long_words, cut)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            ids = batch.column("id")
            found = [Runs(t, *rule).hashes() for t in batch.column("text").to_pylist()]
            if not found:
                continue
            key, check, place = (np.concatenate(x) for x in zip(*found))
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            _, rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            order = np.lexsort((place, rank[row], check, key))
            key, check, place, row = key[order], check[order], place[order], row[order]
            first = _first_of_equal(key, check)
            # A later equal run of this batch goes in any case; the same place of a repeated row is the first one again.
            later = (rank[row] != rank[row[first]]) | (place != place[first])
            keep = later | (first == np.arange(len(first)))
            # Those need no partner: they are dealt out by document, and come out as one row of each.
            of_row = np.zeros(len(found), np.int64)
            of_row[row] = key
            key = np.where(later, of_row[row] + row.astype(np.int64) * np.int64(0x1E3779B97F4A7C15), key)
            at = (check << 32 | place | np.where(later, SURE, 0))[keep]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), ids.take(pa.array(row[keep])), pa.array(at)], names=["key", "id", "at"])

    def later_ones(batches):
        last = None  # the hash and the first (id, place) of the runs at the end of the batch before
        for batch in batches:
            key, at = batch.column("key").to_numpy(), batch.column("at").to_numpy()
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            place, check = at & (SURE - 1), at >> 32
            sure = (at & SURE) != 0
            plain = np.flatnonzero(~sure)
            go = sure.copy()
            if len(plain):
                k, c, i, p = key[plain], check[plain], ids[plain], place[plain]
                first = _first_of_equal(k, c)
                first_id, first_place = i[first], p[first]
                if last is not None and (last[0], last[1]) == (k[0], c[0]):
                    same = first == 0
                    first_id[same], first_place[same] = last[2], last[3]
                go[plain] = (i != first_id) | (p != first_place)
                last = k[-1], c[-1], first_id[-1], first_place[-1]
            at = np.flatnonzero(go)
            if len(at):
                _, first, of_id = np.unique(ids[at], return_index=True, return_inverse=True)
                edges = np.concatenate([[0], np.cumsum(np.bincount(of_id))])
                places = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place[at][np.argsort(of_id, kind="stable")]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at[first])), places], names=["id", "places"])

    spots = texts.mapInArrow(runs, f"key long, id {id_type}, at long")
    in_order = spots.repartition("key").sortWithinPartitions("key", F.shiftright("at", 32), "id", "at")
    repeated = in_order.mapInArrow(later_ones, f"id {id_type}, places array<long>")
    starts = materialize(repeated.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("__starts")), "repeated")

    @F.pandas_udf("struct<text:string,n_removed:int>")
    def strip(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        done = [(t, 0) if s is None else Runs(t, *rule).without(s, t) for t, s in zip(texts, starts)]
        return pd.DataFrame(done, columns=["text", "n_removed"])

    # The documents to change grow with the corpus: the join is a shuffled one at every size.
    joined = docs.join(starts.withColumnRenamed("id", "__id").hint("merge"), F.col(id_col) == F.col("__id"), "left")
    done = joined.withColumn("__done", F.when(F.col("__starts").isNotNull(), strip(text_or_empty(text_col), F.col("__starts"))))
    return done.select(
        *[F.coalesce("__done.text", F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("__done.n_removed", F.lit(0)).alias("n_removed"))
