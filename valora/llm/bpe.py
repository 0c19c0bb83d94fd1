"""Byte-level BPE by ranked merges: encoding in Spark's higher-order functions, decoding by joining pieces.

Texts are gathered into blocks; each block is one row with its distinct words, as arrays of bytes, and its documents
as numbers of words. Every distinct word of a block is folded once: the adjacent pair of the smallest rank is merged,
again and again, and only the two pairs beside a merge are looked up anew. The rank map is a literal, from pairs
of ids to the id of both together, dealt into buckets because a look-up in a single map would read it from
end to end. A block is as large as a task's share of the input allows, so words are not moved between tasks.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm.common import text_or_empty

BUCKETS = 65_521  # a prime, so that both ids of a pair count
# A fold's state is an array of entries: rank of the piece and the next one joined, place of the piece, id of the piece.
ID_BITS, PLACE_BITS = 18, 7
RANK_AT = ID_BITS + PLACE_BITS
NO_ID = 1 << 17  # more than any id: the rank of pairs that do not merge, and the piece at both ends
BLOCK_CHARS = 32_000_000
LONG_WORD = 64  # bytes; a fold costs the square of a word's length, so longer words take the library's own merge
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Buckets of ``none, pair, rank, pair, rank ...``: behind each pair stands the id of its two pieces joined."""
    if max(ranks.values()) >= NO_ID:
        raise ValueError(f"ids must be below {NO_ID}")
    buckets: list[list[int]] = [[NO_ID << RANK_AT] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                key = (left << ID_BITS) + right - (1 << 2 * ID_BITS)  # below zero, so no rank is taken for a pair
                buckets[key % BUCKETS] += [key, rank << RANK_AT]
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")


def byte_literal(ranks: dict[bytes, int]) -> Column:
    """Entry, without its place, of each byte in front of each byte, and in front of the end (256)."""
    first = [ranks[bytes([b])] for b in range(256)]
    pairs = [[*(ranks.get(bytes([b, c]), NO_ID) for c in range(256)), NO_ID] for b in range(256)]
    return F.from_json(F.lit(json.dumps([(rank << RANK_AT) + i for i, row in zip(first, pairs) for rank in row])), "array<bigint>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Hexadecimal piece of each id; null where an id is free."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, ranks: Column, first: Column) -> Column:
    """Ids of one word (an array of its bytes); ``ranks`` and ``first`` are the literals of pairs and of single bytes.

    The state is one array of entries, with an end before and behind, so that every pair has two neighbours. Its
    smallest entry is the leftmost pair of the smallest rank, since the place counts next; a merge makes two entries new.
    """
    id_mask, low_mask = (F.lit((1 << n) - 1).cast("long") for n in (ID_BITS, RANK_AT))
    place_mask, ends = F.lit((1 << RANK_AT) - (1 << ID_BITS)).cast("long"), F.lit((NO_ID << RANK_AT) + NO_ID).cast("long")

    def entry(x: Column) -> Column:
        # x is the place, the id and the next id; where the pair is absent its position is 0, and there the bucket has NO_ID.
        key = x.bitwiseOR(F.lit(-1 << 2 * ID_BITS).cast("long"))
        return let(F.get(ranks, F.pmod(key, F.lit(BUCKETS)).cast("int")), lambda bucket: F.get(
            bucket, F.array_position(bucket, key).cast("int")).bitwiseOR(F.shiftright(x, ID_BITS)))

    def merge(state: Column, _: Column) -> Column:
        def join(least: Column, at: Column) -> Column:
            best = F.shiftright(least, RANK_AT)
            before = F.shiftleft(F.get(state, at - 2).bitwiseAND(low_mask), ID_BITS).bitwiseOR(best)
            here = F.shiftleft(least.bitwiseAND(place_mask).bitwiseOR(best), ID_BITS).bitwiseOR(F.get(state, at + 1).bitwiseAND(id_mask))
            return F.flatten(F.array(F.slice(state, 1, at - 2), F.transform(F.array(before, here), entry), F.slice(state, at + 2, 2 * LONG_WORD)))

        return let(F.array_min(state), lambda least: F.when(least >= NO_ID << RANK_AT, state).otherwise(
            let(F.array_position(state, least).cast("int"), lambda at: join(least, at))))

    start = F.transform(word, lambda b, i: F.get(first, b * 257 + F.coalesce(F.get(word, i + 1), F.lit(256))) + F.shiftleft(i + 1, ID_BITS))
    state = F.flatten(F.array(F.array(ends), start, F.array(ends)))
    return F.aggregate(F.slice(word, 2, F.size(word)), state, merge, lambda s: F.transform(
        F.slice(s, 2, F.size(s) - 2), lambda x: x.bitwiseAND(id_mask).cast("int")))


class _Blocks:
    """Gathers texts and turns them into rows of distinct words and word numbers."""

    def __init__(self, pattern: str, ranks_path: str, id_type: pa.DataType):
        import regex

        self.split = regex.compile(pattern).findall
        self.pattern, self.ranks_path, self.id_type = pattern, ranks_path, id_type
        self.ranks, self.library = None, None
        self.clear()

    def clear(self):
        self.words: dict[str, int] = {}
        self.known: dict[str, bytes | None] = {}
        self.ids, self.rows, self.chars = [], [], 0

    def _numbers(self, words: list[str]) -> bytes:
        seen = self.words
        return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int32).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        # Only a blank before white space makes the cut at that blank depend on what stands around it.
        out = None if not chunk or chunk[0].isspace() else self._numbers(self.split(" " + chunk))
        self.known[chunk] = out
        return out

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        self.ids.append(ids)
        for text in texts:
            self.chars += len(text)
            parts = text.split(" ")
            if any(c in text for c in ODD_SPACE):
                self.rows.append(self._numbers(self.split(text)))
                continue
            try:
                row = [self.known[c] if c in self.known else self._chunk(c) for c in parts[1:]]
                self.rows.append(self._numbers(self.split(parts[0])) + b"".join(row))
            except TypeError:
                self.rows.append(self._numbers(self.split(text)))

    def _given(self, words: list[bytes]) -> list:
        """Ids of the words that are not folded: those that are a piece themselves, and very long ones."""
        if self.ranks is None:
            self.ranks = read_ranks(self.ranks_path)
        if self.library is None and any(len(w) > LONG_WORD for w in words):
            import tiktoken

            self.library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return [
            [self.ranks[w]] if w in self.ranks else self.library.encode_ordinary(w.decode()) if len(w) > LONG_WORD else None for w in words]

    def take(self) -> pa.RecordBatch:
        words = [w.encode() for w in self.words]
        sizes = np.array([len(r) // 4 for r in self.rows], dtype=np.int64)
        numbers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(self.rows), dtype=np.int32)))
        docs = pa.StructArray.from_arrays([pa.concat_arrays(self.ids).cast(self.id_type), numbers], names=["id", "words"])
        lengths = np.cumsum([0] + [len(w) for w in words])
        spelled = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)))
        batch = pa.record_batch({
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), spelled), "given": pa.array([self._given(words)], pa.list_(pa.list_(pa.int32()))),
            "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
        })
        self.clear()
        return batch


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, ids): the ids of each whole text, every match of ``pattern`` on its own, without special tokens.

    As the ``tiktoken`` library gives them. A null or empty text has no ids. Null ids, repeated rows and other columns
    change nothing. One very long text makes a block of its own size.
    """
    ranks = read_ranks(ranks_path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def gather(batches):
        blocks = _Blocks(pattern, ranks_path, pa.int64())
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or blocks.chars + size + len(texts[end]) <= block_chars):
                    size += len(texts[end])
                    end += 1
                blocks.add(batch.column("id").slice(at, end - at), texts[at:end])
                at = end
                if blocks.chars >= block_chars or at < len(texts):
                    yield blocks.take()
        if blocks.rows:
            yield blocks.take()

    blocks = rows.mapInArrow(gather, "words array<array<int>>, given array<array<int>>, docs array<struct<id:long,words:array<int>>>")
    folded = let(rank_literal(ranks), lambda r: let(byte_literal(ranks), lambda first: F.transform(
        "words", lambda w, i: F.coalesce(F.get(F.col("given"), i), fold_word(w, r, first)))))
    coded = let(folded, lambda codes: F.transform("docs", lambda d: F.struct(
        d["id"].alias("id"), F.flatten(F.transform(d["words"], lambda k: F.get(codes, k))).alias("ids"))))
    return blocks.select(F.explode(coded).alias("d")).select(F.col("d.id").alias(id_col), F.col("d.ids").alias("ids"))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ``ids`` stand for: their pieces in a row."""
    return F.unhex(let(piece_literal(ranks), lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))
