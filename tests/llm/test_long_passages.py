"""Repeated passages of 50 words in few long or many short sentences."""

import re
from collections import defaultdict
from zlib import crc32

import pytest

from valora.llm.catalog import QUERIES
from valora.llm.sentence_spans import drop_repeated_passages


def test_long_and_short_sentences_go(spark):
    one = " ".join(f"w{i}" for i in range(57)) + ". "
    two = " ".join(f"x{i}" for i in range(30)) + ". " + " ".join(f"y{i}" for i in range(30)) + "! "
    menu = "".join(f"item{i} one two\n" for i in range(20))  # three lines stay below 12 words
    rows = [(1, one + "Own a."), (2, two + "Own b."), (3, menu + "Own c."), (4, "Other start. " + one + "End."), (5, "Other. " + two + "End."),
            (6, "Other.\n" + menu + "End."), (7, "Short again. " + " ".join(f"w{i}" for i in range(40)) + ".")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in drop_repeated_passages(docs, long_words=50).collect()}
    assert [got[i] for i in (1, 2, 3, 7)] == [(t, 0) for i, t in rows if i in (1, 2, 3, 7)]
    assert got[4] == ("Other start. End.", 1) and got[5] == ("Other. End.", 2) and got[6] == ("Other.\nEnd.", 20)


def test_runs_cover_a_whole_passage(spark):
    rows = []
    for k, lengths in enumerate(([49, 2, 49], [1] * 60, [10] * 9, [25, 25], [80], [3, 45, 3, 45, 3])):
        passage = "".join(" ".join(f"p{k}-{i}-{j}" for j in range(n)) + ". " for i, n in enumerate(lengths))
        rows += [(2 * k, f"Q{k} w{k}. {passage}E{k} r{k}. "), (2 * k + 1, f"A{k} s d. {passage}F{k} g h. ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (3, None):
        got = {r.doc_id: r.text for r in drop_repeated_passages(docs, size=size, long_words=50).collect()}
        assert got == {i: t if i % 2 == 0 else f"A{i // 2} s d. F{i // 2} g h. " for i, t in rows}


def brute_long(rows, least=44, cut=4):
    """Long runs as tuples of words, without hashes, batches or order."""
    places, texts = defaultdict(list), {}
    for i, t in sorted({(i, t) for i, t in rows if t}):
        words, chunks = t.lower().split(), re.findall(r"\S+\s*", t)
        texts[i] = chunks
        stops = [k + 1 for k, w in enumerate(words) if w[-1] in ".!?" or "\n" in chunks[k] or k + 1 == len(words)]
        edges = sorted({0, *stops, *[k for k, w in enumerate(words) if crc32(w.encode()) % cut == 0]})
        spans = {(k, next((e for e in edges if e >= k + least), None)) for k in edges[:-1]}
        spans |= {(next((k for k in reversed(edges) if k <= e - least), None), e) for e in stops}
        for k, end in spans:
            if k is not None and end:
                places[tuple(words[k:end])].append((i, k, end))
    gone = defaultdict(set)
    for same in places.values():
        for i, k, end in sorted(same)[1:]:
            gone[i] |= set(range(k, end))
    return {i: "".join(c for k, c in enumerate(texts[i]) if k not in gone[i]) if gone[i] else t for i, t in rows}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_documents_as_registered(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in drop_repeated_passages(docs, size=None, long_words=44).collect()}
    want = brute_long(rows)
    assert {i: got[i].strip() for i in got} == {i: want[i].strip() for i in want}


def test_passages_inside_sentences_and_small_batches(spark):
    passage = " ".join(f"W{i * 7919 % 1000}x" for i in range(120))
    rows = [(i, f"own{i} start here {passage} and tail{i} {'z' * i} goes on.") for i in range(40)]
    rows += [(100, passage + " middle " + passage), (101, None), (102, ""), (103, " ".join(passage.split()[:40])), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = drop_repeated_passages(docs, size=None, long_words=44).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = brute_long([r for r in rows if r[1] is not None])
    assert all(r.text == want[r.doc_id] for r in out if r.text is not None) and len(out) == len(rows)
    assert all(len(want[i].split()) < 30 for i in range(1, 40)) and want[0] == rows[0][1] and want[103] == rows[43][1]


def test_registered_query_takes_long_passages(spark, tmp_path):
    one = " ".join(f"w{i}" for i in range(57)) + ". "
    spark.createDataFrame([(1, one), (2, "Own. " + one)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in QUERIES["op9_sentence_span_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_registered_query_and_pipeline_take_runs_of_three_sentences(spark, tmp_path):
    from corpus_pipeline import strip_passages

    run = "Rent is paid on the first. Pets are not allowed here. Keys stay with the owner. "
    rows = [(1, "A start. " + run + "An end."), (2, "Another one begins. " + run + "It stops."), (3, "Rent is paid on the first. Pets are not allowed here.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in QUERIES["op9_sentence_span_dedup"](spark, str(tmp_path)).collect()} == {1: 0, 2: 3, 3: 0}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in strip_passages(spark, docs, "").collect()} == {1: rows[0][1], 2: "Another one begins. It stops.", 3: rows[2][1]}
