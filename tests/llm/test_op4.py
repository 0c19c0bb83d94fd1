"""SimHash groups against brute force."""

import itertools

import numpy as np
import xxhash
from pyspark.sql import types as T

from valora.llm.components import connected_components
from valora.llm.simhash_trie import near_fingerprints, simhash, simhash_groups, traverse

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("rep", T.StringType()), T.StructField("component_id", T.StringType())])


def brute_hash(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    runs = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict, budget=3):
    near = {i: [j for j in prints if bin(prints[i] ^ prints[j]).count("1") <= budget] for i in prints}
    out = {}
    for i in prints:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        out[i] = min(seen)
    return out


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r.doc_id: brute_hash(r.text) for r in docs.collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {i: (prints[i], c) for i, c in groups(prints).items()}


def test_traversal_finds_every_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), base ^ np.uint64(7), rng.integers(0, 300, 90, dtype=np.uint64)])
    a = np.unique(near)
    for budget in (0, 1, 3, 5):
        got = sorted((int(i), int(j)) for x, y in traverse(a, a, budget, True) for i, j in zip(x, y))
        assert got == [(i, j) for i, j in itertools.combinations(range(len(a)), 2) if bin(int(a[i] ^ a[j])).count("1") <= budget]
        b, c = a[::2], a[1::2]
        got = sorted((int(b[i]), int(c[j])) for x, y in traverse(b, c, budget, False) for i, j in zip(x, y))
        assert got == sorted((int(x), int(y)) for x in b for y in c if bin(int(x ^ y)).count("1") <= budget)


def test_many_nodes_give_the_same_groups(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(s)) for s in (0, 5, 33, 61, 63)] + [np.arange(50, dtype=np.uint64)]))
    prints = {i: int(v) for i, v in enumerate(values)}
    df = spark.createDataFrame([(int(np.int64(np.uint64(v))), i) for i, v in prints.items()], "fp long, rep long")
    links = near_fingerprints(df, leaf_rows=9)
    parts = {r.node: r.component for r in connected_components(links).collect()}
    assert {i: parts.get(i, i) for i in prints} == groups(prints)


def test_null_empty_long_tied_and_repeated(spark):
    long = "Wort " * 30000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (5, long), (None, long), (6, "a b"), (7, "Ä B"), (8, "ä b")]
    got = simhash_groups(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([
        ("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 4), ("5", 4), ("None", 4), ("6", 6), ("7", 7), ("8", 8)])
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash("A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
