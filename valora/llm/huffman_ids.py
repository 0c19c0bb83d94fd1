"""Token ids in files of canonical, length-limited Huffman codes.

A file holds the documents of one range of ids in ascending order:

    8 bytes magic | codes | index, deflated | footer: four unsigned 64-bit integers, 8 bytes magic

The codes of a document start at a byte; the index has for each document its id, null mark, number of ids and first
byte, for each block of ``BLOCK`` ids the bit where it starts, and the code length of every id. Blocks are
decoded independently, many at a time, through one table of all ``2**MAX_BITS`` bit patterns.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import materialize, scratch_path, store, text_or_empty
from valora.llm.tokens import encoder

MAGIC, MAX_BITS, BLOCK, CHUNK = b"VALHUF01", 16, 256, 1 << 22


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the symbols with a count, by package-merge."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.nonzero(counts)[0]
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    single = counts[order].astype(np.int64)
    n, levels, weights = len(order), [], single
    for _ in range(max_bits - 1):
        packs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, packs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # which entries of this level's list are single symbols
        weights = both[rank]
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_single in reversed(levels):
        singles = int(is_single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


def encode_ids(docs: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """For each document its codes, from a byte on, and the bit at which each of its blocks starts."""
    out = []
    for d in docs:
        bits = lengths[d].astype(np.int64)
        ends = np.cumsum(bits)
        at = ends - bits
        total = int(ends[-1]) if len(d) else 0
        shifted = codes[d] << (np.uint64(64) - bits.astype(np.uint64) - (at & 31).astype(np.uint64))
        word, size = at >> 5, (total >> 5) + 2
        flat = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=size)
        flat[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[:-1]
        out.append((flat.astype(np.uint32).astype(">u4").tobytes()[:(total + 7) // 8], at[::BLOCK].astype(np.uint64)))
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next ``MAX_BITS`` bits."""
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << MAX_BITS, dtype=np.uint32), np.ones(1 << MAX_BITS, dtype=np.int64)
    full = np.repeat(order, spans)
    symbols[:len(full)], sizes[:len(full)] = full, np.repeat(lengths[order], spans)
    return symbols, sizes


def decode_blocks(data: bytes, starts: np.ndarray, counts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at the bits ``starts``, in a row; all blocks step together."""
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].astype(np.int64), counts[order]
    place = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), dtype="<u4")
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(active):
        pos = at[:n]
        byte = pos >> 3
        window = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (8 - (pos & 7))) & 0xFFFF
        out[place[:n] + step] = symbols[window]
        at[:n] = pos + sizes[window]
    return out


def write_id_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, target: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None,
) -> DataFrame:
    """Write the ids of ``docs``, each document closed by ``end_id``, and return the list of files: part, path, n_docs, n_ids.

    Documents are in ascending order of id over the files by ``part`` and within each; null ids come first,
    ties in any order. A null text counts as empty. Other columns are ignored. ``files`` defaults to the
    number of shuffle partitions. More than 65,536 different ids have no codes of 16 bits: that fails the job. Texts are tokenized once, into a stored table of ids; the code is made from
    the counts of all of them, then they are encoded. Each task attempt writes a file of its own name, and only those of
    finished tasks are listed.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = target or scratch_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    kind = encoder(tokenizer_path).kind
    tail = np.array([end_id], dtype=kind).tobytes()

    def tokenize(batches):
        for batch in batches:
            raw = [x + tail for x in encoder(tokenizer_path).encode_short(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("nil"), batch.column("id"), pa.array(raw, pa.binary())], names=["nil", "id", "ids"])

    def flat(column: pa.Array) -> np.ndarray:
        """The ids of all rows of a binary column, which lie behind each other in its buffer."""
        if not len(column):
            return np.zeros(0, kind)
        edges = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], dtype=np.uint8)[edges[0]:edges[-1]].view(kind)

    keyed = rows.select(F.col("id").isNull().alias("nil"), F.coalesce("id", F.lit(0)).alias("id"), "text")
    table_path = scratch_path(spark, "ids")
    keyed.mapInArrow(tokenize, "nil boolean, id long, ids binary").write.option("compression", "zstd").parquet(table_path)
    coded_ids = spark.read.schema("nil boolean, id long, ids binary").parquet(table_path)

    def count(batches):
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.bincount(flat(batch.column("ids")), minlength=len(seen))
            more[:len(seen)] += seen
            seen = more
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[at])], names=["symbol", "n"])

    found = coded_ids.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.symbol for r in found], default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r.symbol] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    cuts = rows.agg(F.percentile_approx("id", [k / files for k in range(1, files)] or [0.5], max(10_000, 20 * files))).first()[0] or []
    edges = np.array(sorted(set(cuts)), dtype=np.int64)

    # Rows without an id stand before all others, in files of their own.
    nil_parts = files if rows.where("id is null").limit(1).count() else 0

    def encode(batches):
        for batch in batches:
            raw, column = batch.to_pandas(), batch.column("ids")
            sizes = raw["ids"].map(len).to_numpy() // kind.itemsize
            docs_of = np.split(flat(column), np.cumsum(sizes)[:-1]) if len(raw) else []
            coded = encode_ids(docs_of, codes, lengths)
            part = nil_parts + np.searchsorted(edges, raw["id"], side="left")
            spread = [zlib.crc32(x) % files if nil else 0 for x, nil in zip(raw["ids"], raw["nil"])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(raw["nil"], spread, part), pa.int32()), batch.column("nil"), batch.column("id"), pa.array(sizes, pa.int64()),
                pa.array([c for c, _ in coded], pa.binary()), pa.array([b.tobytes() for _, b in coded], pa.binary()),
            ], names=["part", "nil", "id", "n", "codes", "blocks"])

    def write(batches):
        out = None
        for pdf in batches:
            for part, rows_of in pdf.groupby("part", sort=True):
                if out is None or out.part != part:
                    if out is not None:
                        yield out.close()
                    out = _Writer(target, int(part), lengths)
                out.add(rows_of)
        if out is not None:
            yield out.close()

    store_fs, folder = store(target)
    store_fs.create_dir(folder, recursive=True)
    coded = coded_ids.mapInArrow(encode, "part int, nil boolean, id long, n long, codes binary, blocks binary")
    # Every task gets one part, or the same number of them.
    ordered = coded.repartitionById(files, F.col("part") % files).sortWithinPartitions("part", F.desc("nil"), "id")
    return materialize(ordered.mapInPandas(write, "part int, path string, n_docs long, n_ids long"), "token-files-list")


class _Writer:
    def __init__(self, target: str, part: int, lengths: np.ndarray):
        self.part, self.lengths, self.path = part, lengths, f"{target}/ids-{part:06d}-{uuid.uuid4().hex}.vhuf"
        fs, where = store(self.path)
        self.out = fs.open_output_stream(where)
        self.out.write(MAGIC)
        self.at, self.ids, self.nils, self.counts, self.firsts, self.blocks = 8, [], [], [], [], []

    def add(self, pdf: pd.DataFrame) -> None:
        sizes = np.array([len(c) for c in pdf["codes"]], dtype=np.int64)
        self.out.write(b"".join(pdf["codes"]))
        self.ids.append(pdf["id"].to_numpy(np.int64))
        self.nils.append(pdf["nil"].to_numpy(bool))
        self.counts.append(pdf["n"].to_numpy(np.int64))
        self.firsts.append(self.at + np.cumsum(sizes) - sizes)
        self.blocks.append(np.frombuffer(b"".join(pdf["blocks"]), dtype=np.uint64))
        self.at += int(sizes.sum())

    def close(self) -> pd.DataFrame:
        cat = lambda x, t: np.concatenate(x).astype(t)
        ids, n = cat(self.ids, np.int64), cat(self.counts, np.int64)
        buffer = io.BytesIO()
        for a in (ids, cat(self.nils, np.uint8), n, cat(self.firsts, np.int64), cat(self.blocks, np.uint64), self.lengths):
            np.save(buffer, a)
        index = zlib.compress(buffer.getvalue(), 1)
        self.out.write(index)
        self.out.write(np.array([self.at, len(index), len(ids), n.sum()], dtype="<u8").tobytes() + MAGIC)
        self.out.close()
        return pd.DataFrame({"part": [self.part], "path": [self.path], "n_docs": [len(ids)], "n_ids": [int(n.sum())]})


def decode_file(path: str):
    """Batches (id, null mark, number of ids, ids in a row) of one file, of about ``CHUNK`` ids each."""
    fs, where = store(path)
    with fs.open_input_file(where) as f:
        end = f.size() - 40
        footer = f.read_at(40, end)
        if f.read_at(8, 0) != MAGIC or footer[32:] != MAGIC:
            raise ValueError(f"not a file of this format: {path}")
        start, size, _, _ = np.frombuffer(footer[:32], dtype="<u8").astype(int)
        buffer = io.BytesIO(zlib.decompress(f.read_at(size, start)))
        ids, nils, n, firsts, blocks, lengths = (np.load(buffer) for _ in range(6))
        symbols, sizes = decode_table(lengths)
        per_doc = -(-n // BLOCK)
        block_at, edges = np.concatenate([[0], np.cumsum(per_doc)]), np.append(firsts, start)
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, side="right")))
            data = f.read_at(int(edges[j] - edges[i]), int(edges[i]))
            docs = np.repeat(np.arange(i, j), per_doc[i:j])
            k = np.arange(block_at[i], block_at[j])
            bits = blocks[k].astype(np.int64) + (firsts[docs] - firsts[i]) * 8
            counts = np.minimum(BLOCK, n[docs] - (k - block_at[docs]) * BLOCK)
            yield ids[i:j], nils[i:j].astype(bool), n[i:j], decode_blocks(data, bits, counts, symbols, sizes)
            i = j


def read_id_files(listing: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the listed files: id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit).

    Null ids come back null, empty texts with the end id alone, repeated rows as often as they were written; a
    listing without files gives no rows. A file cut short or of another format fails the job.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    offsets = materialize(listing.select("part", "path", F.coalesce(before, F.lit(0)).alias("before")), "token-files-list")

    def read(batches):
        for pdf in batches:
            for path, at in zip(pdf["path"], pdf["before"]):
                for ids, nils, n, flat in decode_file(path):
                    ends = np.cumsum(n)
                    raw = flat.tobytes()
                    yield pd.DataFrame({
                        "nil": nils, "id": ids, "start": at + ends - n, "n_tokens": n, "ids": [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())],
                    })
                    at += int(ends[-1])

    found = offsets.repartition(max(1, offsets.count()), "part").mapInPandas(read, "nil boolean, id long, start long, n_tokens long, ids binary")
    return found.select(F.when(~F.col("nil"), F.col("id")).alias(id_col), "start", "n_tokens", "ids")
