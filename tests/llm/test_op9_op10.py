"""Repeated passages and licence scans against brute force and by hand."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import types as T

from valora.llm.license_automaton import BASE, TEMPLATES, LicenceScanner, SuffixAutomaton, scan_licences, words_of
from valora.llm.sentence_spans import drop_repeated_passages, sentences

NAMES = ["h", "id", "pos", "first", "_starts_"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.StringType()) for n in NAMES])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcde") for i, t in rows], SCHEMA)


def brute_passages(rows, size=3, least=12):
    """Equal runs found by comparing texts, not hashes."""
    runs, parts = defaultdict(list), {}
    for i, t in rows:
        parts[i] = sentences(t or "")
        at = [k for k, p in enumerate(parts[i]) if p.split()]
        for k in range(len(at) - size + 1):
            key = tuple(tuple(parts[i][j].lower().split()) for j in at[k:k + size])
            if sum(map(len, key)) >= least:
                runs[key].append((i, at[k:k + size]))
    gone = defaultdict(set)
    for places in runs.values():
        for i, at in sorted(places)[1:]:
            gone[i] |= set(at)
    return {i: ("".join(p for k, p in enumerate(parts[i]) if k not in gone[i]) if gone[i] else t, len(gone[i])) for i, t in rows}


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.text, r.n_removed) for r in drop_repeated_passages(docs).collect()}
    assert got == brute_passages(rows)


def test_passages_by_hand(spark):
    p = "Alpha beta gamma delta one. Second sentence goes here too! Third one closes the passage now? "
    long = "no stop here " * 20000 + "!" * 50000
    rows = [(1, "Own start here. " + p + "Own end of one."), (2, "Other words. " + p.upper() + "Last."), (3, p.replace(" ", "\t")), (4, None), (5, ""),
            (6, long), (7, long), (8, p + "x y z. " + p), (9, "A b. C d. E f."), (10, "A b. C d. E f.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in drop_repeated_passages(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)
    assert got[1] == (rows[0][1], 0) and got[2] == ("Other words. Last.", 3) and got[3] == ("", 3) and got[8] == ("x y z. ", 6)
    assert got[4] == (None, 0) and got[9][1] == got[10][1] == 0
    odd = frame(spark, [(None, p), (None, p), (5, p), (5, p)])
    assert [r.n_removed for r in drop_repeated_passages(odd).collect()] == [0] * 4
    assert drop_repeated_passages(odd).columns == ["doc_id", "text", *NAMES, "n_removed"]
    assert drop_repeated_passages(odd.where("false")).count() == 0


def test_sentences_lose_nothing():
    for t in ("", " ", "\n\n", "a.b c. d\n\n e! ", "x", "... !? a", "a.\n\nb.\n"):
        assert "".join(sentences(t)) == t


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    w = brute_words(text)
    hits = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def base_of(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_phrases_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    for d in docs.collect():
        assert base_of(got[d.doc_id]) == brute_base(d.text)
        assert set(filter(None, got[d.doc_id].base_labels.split(","))) <= set(got[d.doc_id].labels.split(",")) and 0 <= got[d.doc_id].score <= 1


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(4)
    seqs = [[b"%d" % x for x in rng.integers(0, 4, n)] for n in (30, 25, 7)]
    a = SuffixAutomaton(seqs)
    runs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(30):
        text = [b"%d" % x for x in rng.integers(0, 5, 60)]
        best = [max([n for n in range(1, e + 1) if tuple(text[e - n:e]) in runs], default=0) for e in range(1, 61)]
        want = [(e + 1 - best[e], best[e]) for e in range(60) if best[e] >= 3 and (e == 59 or best[e + 1] <= best[e])]
        assert [(s, n) for s, n, _ in a.matches(text, 3)] == want


def test_template_spans_and_odd_texts(spark):
    mit, apache = TEMPLATES["mit"][0], TEMPLATES["apache-2"][0]
    changed = mit.replace("without restriction", "freely").replace("publish, ", "")
    rows = [(1, "Intro words. " + mit + " Tail."), (2, changed), (3, apache[:len(apache) // 2] + " cut " + apache[len(apache) // 2:]), (4, None), (5, ""),
            (6, "the MIT\tLicense; The mit license the\nmit-license"), (7, "Über the café Ünder software " * 20000), (8, "CC-BY-NC and the Apache License, Version 2.0"),
            (9, "The rights to use this software"), (None, "cc by nc"), (None, "cc by nc")]
    rows_got = scan_licences(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in rows_got}
    for i, t in rows:
        assert base_of(got[i]) == brute_base(t)
    assert (got[1].labels, got[2].labels, got[3].labels) == ("mit", "mit", "apache-2")
    assert got[1].score == 1 and got[2].score > 0.8 and [(s.label, s.first) for s in got[1].spans] == [("mit", 2)]
    assert (got[4].labels, got[4].score, got[9].labels, got[7].labels) == ("", 0.0, "", "")
    assert got[8].labels == "apache-2,cc-by-nc" and len([r for r in rows_got if r.doc_id is None]) == 2
    assert scan_licences(frame(spark, rows).where("false")).count() == 0
    assert words_of("A-b\x00c é") == [b"a", b"b", b"c", "é".encode()]
    s = LicenceScanner({"x": ["a b c d e f g h"]}, {}, 3, 2, 0.5)
    assert s.spans([b"a", b"b", b"c", b"q", b"d", b"e", b"f"]) == [(0, 0, 6, 0.75)]


def test_phrases_by_automaton_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        phrases = {" ".join("abc"[x] for x in rng.integers(0, 3, rng.integers(1, 5))): f"l{i % 3}" for i in range(6)}
        words = [b"abcd"[x:x + 1] for x in rng.integers(0, 4, 40)]
        s = LicenceScanner({}, phrases, 5, 12, 0.6)
        want = sorted((i, label) for p, label in phrases.items() for i in range(40) if words[i:i + len(p.split())] == p.encode().split())
        assert s.phrases(words) == want
    assert LicenceScanner({}, {"": "x", "a b": "y", "a  B": "z"}, 5, 12, 0.6).phrases([b"a", b"b"]) == [(0, "y"), (0, "z")]


def test_each_notice_has_its_own_label_only():
    s = LicenceScanner(TEMPLATES, BASE, 5, 12, 0.6)
    for label, texts in TEMPLATES.items():
        for text in texts:
            found = s.scan(f"Some words before. {text} Others follow it.")
            assert {h["label"] for h in found["spans"]} == {label} and found["score"] == 1, (label, found)
    both = s.scan(" and then many other words follow here in between the two of them as usual ".join([TEMPLATES["gpl-2"][0], TEMPLATES["lgpl-2.1"][0]]))
    assert [h["label"] for h in sorted(both["spans"], key=lambda h: h["first"])] == ["gpl-2", "lgpl-2.1"]
    # The same words cover two labels: the better covered one stays, also where a word between the runs differs.
    r = LicenceScanner({"x": ["a b c d e f g h i j"], "y": ["a b c d e q q f g h i j"]}, {}, 5, 12, 0.6)
    edited = r.scan("a b c d e z f g h i j")
    assert len(r.spans(words_of("a b c d e z f g h i j"))) == 2 and edited["labels"] == "x"
    # Equally well covered labels both stay.
    t = LicenceScanner({"x": ["a b c d e f"], "y": ["a b c d e g"]}, {}, 5, 12, 0.6)
    assert t.scan("a b c d e")["labels"] == "x,y" and t.scan("a b c d e g")["labels"] == "y"


def test_base_phrases_are_those_of_the_contract(spark):
    rows = [(1, "Released under the MIT License."), (2, "See the MIT License."), (3, "Under\tthe mit-license, the mit license; under the mit license")]
    got = {r.doc_id: r for r in scan_licences(frame(spark, rows)).collect()}
    assert [base_of(got[i]) for i in (1, 2, 3)] == [(5, 1, 1, 1, "mit"), (4, 0, None, None, ""), (11, 2, 0, 7, "mit")]
