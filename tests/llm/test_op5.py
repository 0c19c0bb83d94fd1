"""Order MinHash against a brute-force version, and edits by hand."""

import hashlib

from pyspark.sql import functions as F, types as T

from valora.llm import catalog
from valora.llm.order_minhash import BIN_BITS, K, PICK, fingerprint, fingerprint_edits, likeness

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()),
                       T.StructField("fp", T.StringType()), T.StructField("n", T.StringType())])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    """With k-mers as tuples of words, numbered by counting."""
    import struct

    import xxhash

    def spark_hash(*longs):  # XXH64 of each eight bytes, seeded with the hash so far
        h = 42
        for x in longs:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return signed(h)

    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in text.split()]
    runs = [tuple(words[i:i + K]) for i in range(len(words) - K + 1)] or ([tuple(words)] if words else [])
    seen, out = {}, {}
    for at, run in enumerate(runs):
        h = spark_hash(*run) & ~0xFFFFFF
        n = seen[run] = seen.get(run, -1) + 1
        if n:
            import ctypes
            # the number is a 32-bit integer
            step = xxhash.xxh64_intdigest(struct.pack("<q", ctypes.c_int64(h).value), 42)
            h = (int_hash(n, step)) & ~0xFFFFFF
        x = (h & ((1 << 64) - 1)) | at
        out.setdefault(x >> (64 - BIN_BITS), []).append(x)
    parts = []
    for b, xs in sorted(out.items()):
        picked = sorted(xs)[:PICK]
        ordered = [x >> 24 for x in sorted(picked, key=lambda x: x & 0xFFFFFF)]
        parts.append(f"{b:02X}{spark_hash(*ordered) & 0xFFFFFFFF:08X}")
    return ".".join(parts)


def int_hash(value, seed):
    """XXH64 of the four bytes of an integer."""
    import struct

    import xxhash

    return signed(xxhash.xxh64_intdigest(struct.pack("<i", value), seed))


def test_fingerprints_against_brute_force(spark):
    texts = ["", " ", "a", "a b", "a b c", "a b c d e f", "x y z " * 40, "q " * 3000, " ".join(f"w{i * i % 97}" for i in range(800)), "Ünï cödé wörds hier und da"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprint(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == {t: brute(t) for t in texts}


def test_order_and_number_of_kmers_count(spark):
    base = [f"w{i}" for i in range(300)]
    swapped = base[150:] + base[:150]
    rows = [(" ".join(base), " ".join(swapped)), ("a b c d " * 50, "a b c d " * 100), (" ".join(base), " ".join(base[:-3] + ["x", "y", "z"])), ("", "a"), ("", ""), ("a", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).collect()
    values = [r[0] for r in got]
    assert values[0] < 0.75 and values[1] < 0.9 and values[2] > 0.8 and values[3:] == [0.0, 1.0, 1.0]


def edits(rows):
    ids = sorted({i for i, _ in rows}, key=lambda i: -1 << 70 if i is None else i)
    first = {i: min((t or "") for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        t, n = t or "", len(t or "")
        after = first[ids[(ids.index(i) + 1) % len(ids)]]
        out.append((str(i), n, t[:n - n // 4] + after[:n // 4]))
    return sorted(out)


def test_edited_texts(spark):
    rows = [(5, "Äußerst 𝔘 many words here, all of them fine"), (9, "short"), (7, None), (11, ""), (100, "long text " * 20000), (-3, "abc"), (9000000000, "zz top band")]
    for case in (rows, rows + [(None, "nil one two"), (None, "nil one two")], rows[:1], rows + [(5, "Äußerst 𝔘 many words here, all of them fine")]):
        df = spark.createDataFrame([(*r, "p", "q", "r") for r in case], SCHEMA)
        got = fingerprint_edits(df).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_text) for r in got) == edits(case)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint_edits(df.where("false")).count() == 0


def test_given_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = catalog.QUERIES["op5_order_minhash"](spark, sf_dir).collect()
    want = sorted((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in edits(docs))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert sum(r.near_edited for r in got) / len(got) > 0.25 and sorted(r.near_next for r in got)[len(got) // 2] < 0.05
