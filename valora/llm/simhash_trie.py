"""SimHash fingerprints of word shingles, joined within a Hamming distance by a binary trie.

The distinct fingerprints form a binary trie. Its top is cut into nodes of bounded size; a joint traversal
of the top gives the node pairs whose prefixes differ in few enough bits, and each such pair is traversed
further in a task of its own: both nodes step down together, differing bits add up, and a pair of nodes
whose sum exceeds the budget is left with all that stands below it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty, union_roots
from valora.llm.components import connected_components

BITS = 64
STEP = 8  # levels of the trie counted at a time
FRONTIER = 1 << 17  # node pairs held at a time
SLICE = 4096  # fingerprints that travel in one row
SMALL = 64  # node pairs with so few leaf pairs are compared leaf by leaf


def shingles(text: str, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; a shorter text is one run, an empty one none."""
    words = text.encode().lower().split()  # on bytes both touch ASCII only
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> np.ndarray:
    runs = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(r, seed) for r in runs), dtype="<u8", count=len(runs))


def simhash_of(hashes: np.ndarray) -> int:
    """Unsigned; a bit is 1 where over half of the shingle hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, size: int = 3, seed: int = 42) -> int:
    return simhash_of(shingle_hashes(text, size, seed))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer. A null text counts as empty: fingerprint zero."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, size, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), fp(text_or_empty(text_col)).alias("fp"))


def _cut(fps: DataFrame, leaf_rows: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the nodes the trie is cut into, in order: at most ``leaf_rows`` leaves each.

    Counts ``STEP`` levels at a time below the nodes that are still too large.
    """
    nodes, open_nodes, depth = [], {0: None}, 0

    def split(prefix, level, bottom, counts):
        n = sum(counts.values())
        if n <= leaf_rows or level == BITS:
            nodes.append((prefix, level))
        elif level == bottom:
            open_nodes[prefix] = None
        else:
            for bit in (0, 1):
                child = (prefix << 1) | bit
                split(child, level + 1, bottom, {k: v for k, v in counts.items() if k >> (bottom - level - 1) == child})

    while open_nodes:
        bottom = depth + STEP
        upper = lambda d: F.shiftrightunsigned("fp", BITS - d) if d < BITS else F.col("fp")
        wanted = fps if depth == 0 else fps.where(upper(depth).isin(list(open_nodes)))
        counts: dict[int, dict[int, int]] = {p: {} for p in open_nodes}
        for key, n in wanted.groupBy(upper(bottom).alias("k")).count().collect():
            key %= 1 << BITS
            counts[key >> STEP][key] = n
        tops, depth, level = list(open_nodes), bottom, depth
        open_nodes.clear()
        for p in tops:
            split(p, level, bottom, counts[p])
    return sorted(nodes, key=lambda x: x[0] << (BITS - x[1]))


def _node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    start = np.array([p << (BITS - d) for p, d in nodes], dtype=np.uint64)
    depth = np.array([d for _, d in nodes])
    out = []
    for i in range(len(nodes)):
        shared = np.minimum(depth[i], depth[i:])
        mask = np.array([((1 << int(s)) - 1) << (BITS - int(s)) for s in range(BITS + 1)], dtype=np.uint64)[shared]
        out += [(i, i + int(j)) for j in np.nonzero(np.bitwise_count((start[i] ^ start[i:]) & mask) <= budget)[0]]
    return out


def traverse(a: np.ndarray, b: np.ndarray, budget: int, same: bool):
    """Index pairs (i of a, j of b) within ``budget`` bits; a and b are sorted. With ``same``, i < j only."""
    first = np.array([[0, len(a), 0, len(b), 0]], dtype=np.int64)
    stack = [(BITS - 1, first)] if len(a) and len(b) else []
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(bit, part) for part in np.array_split(pairs, 2)]
            continue
        alo, ahi, blo, bhi, diff = pairs.T
        small = (ahi - alo) * (bhi - blo) <= SMALL if bit >= 0 else np.ones(len(pairs), bool)
        if small.any():
            yield from _leaves(a, b, pairs[small], budget, same)
            pairs = pairs[~small]
            alo, ahi, blo, bhi, diff = pairs.T
        if not len(pairs):
            continue
        one = np.uint64(1) << np.uint64(bit)
        high = ~((one << np.uint64(1)) - np.uint64(1)) if bit < BITS - 1 else np.uint64(0)
        amid = np.clip(np.searchsorted(a, (a[alo] & high) | one), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & high) | one), blo, bhi)
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(pairs), bool)
        below = [
            np.stack([alo, amid, blo, bmid, diff], 1), np.stack([amid, ahi, bmid, bhi, diff], 1),
            np.stack([alo, amid, bmid, bhi, diff + 1], 1), np.stack([amid, ahi, blo, bmid, diff + 1], 1)[~twin],
        ]
        below = np.concatenate(below)
        keep = (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2]) & (below[:, 4] <= budget)
        if keep.any():
            stack.append((bit - 1, below[keep]))


def _leaves(a, b, pairs, budget, same):
    alo, ahi, blo, bhi, _ = pairs.T
    wide, n = bhi - blo, (ahi - alo) * (bhi - blo)
    for part in np.array_split(np.arange(len(pairs)), max(1, int(n.sum()) // FRONTIER)):
        m = n[part]
        at = np.repeat(part, m)
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        i, j = alo[at] + k // wide[at], blo[at] + k % wide[at]
        ok = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            ok &= i < j
        yield i[ok], j[ok]


def near_fingerprints(fps: DataFrame, budget: int = 3, leaf_rows: int = 16384, max_nodes: int = 2048) -> DataFrame:
    """Links (a, b) that connect every two rows of ``fps`` (distinct fp, rep) within ``budget`` bits.

    Not all pairs: for each node pair one link per fingerprint, to the smallest rep it is joined with there.
    """
    leaf = max(leaf_rows, fps.count() // max_nodes)
    nodes = _cut(fps, leaf)
    pairs = _node_pairs(nodes, budget)
    starts = np.array([p << (BITS - d) for p, d in nodes], dtype=np.uint64)
    takes: list[list[tuple[int, bool]]] = [[] for _ in nodes]
    for k, (i, j) in enumerate(pairs):
        takes[i].append((k, True))
        if j != i:
            takes[j].append((k, False))
    same_node = np.array([i == j for i, j in pairs])
    slices = max(1, leaf // SLICE)

    @F.pandas_udf("int")
    def node_of(fp: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, fp.to_numpy().view(np.uint64), side="right").astype(np.int32) - 1)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": [key[0]], "fps": [pdf["fp"].to_numpy().tobytes()], "reps": [pdf["rep"].to_numpy().tobytes()]})

    def deal(batches):
        for pdf in batches:
            for node, fp, rep in zip(pdf["node"], pdf["fps"], pdf["reps"]):
                for k, left in takes[node]:
                    yield pd.DataFrame({"pair": [k], "left_side": [left], "fps": [fp], "reps": [rep]})

    def unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fp = np.frombuffer(b"".join(pdf["fps"]), dtype=np.uint64)
        order = np.argsort(fp)
        return fp[order], np.frombuffer(b"".join(pdf["reps"]), dtype=np.int64)[order]

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["left_side"].to_numpy()
        same = bool(same_node[key[0]])
        a, rep = unpack(pdf[left])
        b, shift = a, 0
        if not same:
            b, more = unpack(pdf[~left])
            rep, shift = np.concatenate([rep, more]), len(a)
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        parent = np.arange(len(rep))
        for i, j in traverse(a, b, budget, same):
            union_roots(parent, place[i], place[j + shift])
        root = parent
        while not np.array_equal(root, parent[root]):
            root = parent[root]
        moved = root != np.arange(len(rep))
        return pd.DataFrame({"a": rep[order][moved], "b": rep[order][root[moved]]})

    sliced = fps.select("fp", "rep", node_of("fp").alias("node"), F.pmod(F.xxhash64("fp"), F.lit(slices)).alias("slice"))
    blobs = sliced.groupBy("node", "slice").applyInPandas(gather, "node int, fps binary, reps binary")
    dealt = blobs.mapInPandas(deal, "pair int, left_side boolean, fps binary, reps binary")
    return dealt.groupBy("pair").applyInPandas(join, "a long, b long")


def simhash_groups(
    docs: DataFrame, size: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``budget`` or fewer differing bits; ``component_id`` is the smallest id reachable.
    Null and word-free texts have fingerprint zero and link like any other. A row with a null id gets the
    component of its fingerprint, and null where only rows with null ids have it. Repeated rows give
    repeated rows. Other columns are ignored. Equal fingerprints are compared once.
    """
    prints = materialize(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "fingerprints")
    parts = connected_components(near_fingerprints(fps, budget))
    named = fps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
