"""A stored word index: postings in blocks with bounds, written once and read by many searches.

A segment holds the documents of one call of :func:`add_segment`; a search reads all segments. The postings of a
word are dealt to blocks by impact class (how much the word weighs in the document) and, within a class, by a
hash of the document, so that no task ever orders or gathers a whole word. Every block tells its highest term
frequency and shortest document, which bound what it can add to a score for any mean length: blocks that
cannot lift a document into the result are not read. The same hash finds the blocks that hold what a candidate
still lacks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valora.functions.numeric import half_up
from valora.functions.parse import tokenize
from valora.operators.ordering import top_k
from valora.session import materialize

CLASSES = 16
BLOCK = 512  # postings in a block, about
BLOCKS = "segment STRING, token STRING, class INT, sub INT, subs INT, n INT, max_tf INT, min_dl INT, ids ARRAY<BIGINT>, tfs ARRAY<INT>, dls ARRAY<INT>"
TERMS = "segment STRING, token STRING, df BIGINT"
SIZES = "segment STRING, n BIGINT, words BIGINT"


def add_segment(docs: DataFrame, path: str, k1: float = 1.5, b: float = 0.75) -> None:
    """Index ``docs`` (id, text) as a new segment of the index at ``path``.

    Ids must not stand in another segment. Documents without words have no postings but count for the mean
    length; null texts count as empty. ``k1`` and ``b`` only shape the impact classes.
    """
    segment = uuid.uuid4().hex
    words = docs.select("id", F.coalesce(tokenize("text"), F.array().cast("array<string>")).alias("t")).select("id", F.size("t").alias("dl"), "t")
    tf = words.select("id", "dl", F.explode("t").alias("token")).groupBy("id", "dl", "token").agg(F.count("*").cast("int").alias("tf"))
    counts = materialize(tf, "postings")
    sizes = materialize(words.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")), "sizes")
    mean = sizes.select(F.col("words") / F.greatest("n", F.lit(1))).scalar()
    impact = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(mean, F.lit(1.0))))
    classed = counts.withColumn("class", F.floor(impact * CLASSES).cast("int"))
    split = materialize(classed.groupBy("token", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs")), "splits")
    keyed = classed.join(split, ["token", "class"]).withColumn("sub", _sub(F.col("id"), F.col("subs")))
    blocks = keyed.groupBy("token", "class", "sub", "subs").agg(F.collect_list(F.struct("id", "tf", "dl")).alias("p"))
    blocks = blocks.select(
        F.lit(segment).alias("segment"), "token", "class", "sub", "subs", F.size("p").alias("n"), F.array_max("p.tf").alias("max_tf"),
        F.array_min("p.dl").alias("min_dl"), F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    # In order of words, so that a search of few words skips row groups by their bounds.
    blocks.repartitionByRange("token").sortWithinPartitions("token", "class").write.mode("append").parquet(f"{path}/blocks")
    terms = split.select("token").distinct().join(classed.groupBy("token").agg(F.count("*").alias("df")), "token")
    terms.select(F.lit(segment).alias("segment"), "token", "df").write.mode("append").parquet(f"{path}/terms")
    # The segment counts from here on.
    sizes.select(F.lit(segment).alias("segment"), "n", "words").write.mode("append").parquet(f"{path}/sizes")


def _sub(doc: Column, subs: Column) -> Column:
    return F.pmod(F.xxhash64(doc), subs).cast("int")


@dataclass(frozen=True)
class Hits:
    """Results of a search, and how many postings it read of those that its words have."""

    rows: DataFrame
    read: DataFrame


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
           seed_postings: int = 2000) -> Hits:
    """Okapi BM25 over all segments: the ``k`` best documents of each query (qid, text), exactly.

    A negative idf is raised to ``epsilon`` times the mean idf; documents without any word of the query are
    not returned; ties go to the smaller id. ``read`` has one row: postings (of the words of all queries) and
    postings_read, both counted for each query on its own.
    """
    sizes = spark.read.schema(SIZES).parquet(f"{path}/sizes")
    done = sizes.select("segment")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(done, "segment", "left_semi")
    terms = spark.read.schema(TERMS).parquet(f"{path}/terms").join(done, "segment", "left_semi")
    total = sizes.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, avgdl = total.n or 0, (total.words or 0) / max(total.n or 0, 1) or 1.0
    weight = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))

    by_word = terms.groupBy("token").agg(F.sum("df").alias("df"))
    by_word = materialize(by_word.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    floor_idf = by_word.agg(F.avg("raw")).scalar() * F.lit(epsilon)
    asked = queries.select("qid", F.explode(tokenize("text")).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qn"))
    boost = F.when(F.col("raw") < 0, floor_idf).otherwise(F.col("raw")) * F.col("qn")
    asked = materialize(asked.join(by_word, "token").select("qid", "token", "df", boost.alias("boost")), "asked")

    # Heads of the blocks of the words asked for: bounds and sizes, no postings.
    words = asked.select("token").distinct()
    heads = blocks.select("segment", "token", "class", "sub", "subs", "n", weight(F.col("max_tf"), F.col("min_dl")).alias("most")).join(words, "token")
    heads = materialize(heads, "heads")
    tops = heads.groupBy("token").agg(F.max("most").alias("most"))
    qt = materialize(asked.join(tops, "token").withColumn("top", F.greatest(F.col("boost") * F.col("most"), F.lit(0.0))).drop("most"), "query-terms")

    key = ["segment", "token", "class", "sub"]

    def postings(wanted: DataFrame) -> DataFrame:
        """(qid, id, s, top): what the wanted blocks (qid, boost, top, block) add to each document."""
        rows = wanted.select("qid", "boost", "top", *key).join(blocks.select(*key, "ids", "tfs", "dls"), key)
        each = rows.select("qid", "boost", "top", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return each.select("qid", F.col("p.ids").alias("id"), (F.col("boost") * weight(F.col("p.tfs"), F.col("p.dls"))).alias("s"), "top")

    # The heaviest blocks of each query, up to a number of postings, give a first k-th score. Only words that
    # add take part, so a partial score is never above the whole one but for words that subtract (debt).
    asks = qt.join(heads.drop("subs"), "token").withColumn("bound", F.greatest(F.col("boost") * F.col("most"), F.lit(0.0)))
    heaviest = W.partitionBy("qid").orderBy(F.desc("bound"), "token", "segment", "class", "sub").rowsBetween(W.unboundedPreceding, -1)
    seeds = asks.where("boost > 0").withColumn("before", F.coalesce(F.sum("n").over(heaviest), F.lit(0))).where(F.col("before") < seed_postings)
    partial = postings(seeds).groupBy("qid", "id").agg(F.sum("s").alias("s"))
    kth = top_k(partial, ["qid"], [F.desc("s"), F.col("id")], k).groupBy("qid").agg(F.count("*").alias("c"), F.min("s").alias("bar")).where(F.col("c") >= k)
    sums = qt.groupBy("qid").agg(F.sum("top").alias("all_tops"), F.sum(F.least(F.col("boost"), F.lit(0.0)) * (k1 + 1)).alias("debt"))
    bars = materialize(sums.join(kth, "qid", "left").select("qid", "all_tops", (F.col("bar") + F.col("debt")).alias("bar")), "bars")

    # Words in order of the most they add: those that together stay below the bar bring no document in.
    cheap = W.partitionBy("qid").orderBy("top", "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    judged = materialize(qt.join(bars, "qid").withColumn("upto", F.sum("top").over(cheap)).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(_parts(qt.select("qid").distinct().count(), QUERIES))).cast("int")), "judged")
    # The blocks that gave the first k-th score are read too, whatever their bounds.
    name = F.xxhash64("segment", "class", "sub")
    judged = judged.join(seeds.groupBy("qid", "token").agg(F.collect_list(name).alias("seeds")), ["qid", "token"], "left")
    parts = F.explode(F.sequence(F.lit(0), F.lit(_parts(n, DOCS) - 1)))
    dealt = blocks.select("token", name.alias("name"), "sub", "subs", weight(F.col("max_tf"), F.col("min_dl")).alias("most"), "ids", "tfs", "dls")
    dealt = dealt.join(materialize(judged.select("token", "block").distinct(), "words"), "token").mapInArrow(_deal(_parts(n, DOCS)), PIECES)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id BIGINT, score DOUBLE, n BIGINT"
    found = dealt.groupBy("part", "block").cogroup(judged.withColumn("part", parts).groupBy("part", "block")).applyInArrow(_score(k, k1, b, avgdl), schema)
    found = materialize(found, "found")
    rows = top_k(found.where("id IS NOT NULL"), ["qid"], [F.desc("score"), F.col("id")], k, "rank").select("qid", "rank", "id", "score")

    whole = qt.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar()
    return Hits(rows, found.agg(whole.alias("postings"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings_read")))


SLACK = 1.000001
DOCS, QUERIES = 4096, 512  # documents and queries, about, that are scored in one go
PIECES = "token STRING, part INT, block INT, name BIGINT, sub INT, subs INT, most DOUBLE, ids ARRAY<BIGINT>, tfs ARRAY<INT>, dls ARRAY<INT>"


def _parts(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def _hash(ids: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    h = (np.uint64(50) + five) ^ (turn(ids.astype(np.int64).view(np.uint64) * two, 31) * one)
    h = turn(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _deal(parts: int):
    """Cut blocks into pieces by part, a hash of the document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("ids", "tfs", "dls")}
            flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
            size = lists["ids"].value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(size)), size) * parts + _hash(flat["ids"]) % parts
            order = np.argsort(at, kind="stable")
            piece, first = np.unique(at[order], return_index=True)
            offsets = pa.array(np.append(first, len(at)), pa.int32())
            row = pa.array(piece // parts)
            whole = {c: batch.column(c).take(row) for c in ("token", "block", "name", "sub", "subs", "most")}
            cut = {c: pa.ListArray.from_arrays(offsets, pa.array(v[order])) for c, v in flat.items()}
            yield pa.record_batch({
                "token": whole["token"], "part": pa.array((piece % parts).astype(np.int32)), "block": whole["block"].cast(pa.int32()), "name": whole["name"],
                "sub": whole["sub"], "subs": whole["subs"], "most": whole["most"], **cut})

    return run


def _score(k: int, k1: float, b: float, avgdl: float):
    """The ``k`` best documents of a part for each query of a block, and ``n``, the postings read for it (on a row of its own).

    A piece is read for a query if its bound and the most that all other words can add reach the bar; where there is
    no bar, all are. A document that stands in no such piece cannot reach it either. Of the other pieces those are read
    where a document that can still reach the bar would stand.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(pieces: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if pieces.num_rows and asked.num_rows:
            vocabulary = pc.unique(asked["token"])
            token = pc.index_in(pieces["token"], value_set=vocabulary).to_numpy().astype(np.int64)
            pieces, token = pieces.take(pa.array(np.argsort(token, kind="stable"))), np.sort(token)
            low, high = (np.searchsorted(token, np.arange(len(vocabulary)), side) for side in ("left", "right"))
            sub, subs, most = (pieces[c].to_numpy() for c in ("sub", "subs", "most"))
            name = pieces["name"].to_numpy()
            size = pc.list_value_length(pieces["ids"]).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            docs, row = np.unique(pc.list_flatten(pieces["ids"]).to_numpy(), return_inverse=True)
            tf, dl = (pc.list_flatten(pieces[c]).to_numpy() for c in ("tfs", "dls"))
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            places = _hash(docs)
            asked = asked.take(pc.sort_indices(asked, sort_keys=[("qid", "ascending"), ("token", "ascending")]))
            qid, seeds = asked["qid"].combine_chunks(), asked["seeds"].combine_chunks()
            term = pc.index_in(asked["token"], value_set=vocabulary).to_numpy().astype(np.int64)
            boost, top, total, upto = (asked[c].to_numpy() for c in ("boost", "top", "all_tops", "upto"))
            bars = asked["bar"].to_numpy().astype(np.float64)  # null: NaN
            codes = pc.rank(qid, tiebreaker="dense").to_numpy()
            for lo, hi in zip(*(np.searchsorted(codes, np.unique(codes), side) for side in ("left", "right"))):
                s, used, hit, read, shut = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), bool), 0, []
                bar = -np.inf if np.isnan(bars[lo]) else bars[lo]
                for j in range(lo, hi):
                    p = slice(low[term[j]], high[term[j]])
                    if p.start == p.stop:
                        continue
                    bound = np.maximum(boost[j] * most[p], 0.0)
                    wanted = ((total[j] - top[j] + bound) * SLACK + 1e-9 >= bar) & (upto[j] * SLACK + 1e-9 >= bar)
                    n = slice(ends[p.start], ends[p.stop])
                    r, w = row[n], weight[n]
                    if not wanted.all():
                        shut.append((j, p, n, wanted))
                        inside = np.repeat(wanted, size[p])
                        r, w = r[inside], w[inside]
                    s[r] += boost[j] * w
                    used[r] += top[j]
                    hit[r] = True
                    read += len(r)
                    if shut and shut[-1][0] == j and seeds[j].is_valid:
                        read += size[p][~wanted & np.isin(name[p], seeds[j].values.to_numpy())].sum()
                alive = hit & ((s + total[lo] - used) * SLACK + 1e-9 >= bar)
                if alive.any():
                    for j, p, n, wanted in shut:
                        look = np.zeros(p.stop - p.start, bool)
                        for u in np.unique(subs[p]):
                            stands = np.zeros(u, bool)
                            stands[places[alive] % u] = True
                            here = subs[p] == u
                            look[here] = stands[sub[p][here]]
                        look &= ~wanted
                        read += size[p][look & ~np.isin(name[p], seeds[j].values.to_numpy() if seeds[j].is_valid else [])].sum()
                        inside = np.repeat(look, size[p]) & alive[row[n]]
                        s[row[n][inside]] += boost[j] * weight[n][inside]
                best = np.nonzero(alive)[0]
                score = np.floor(s[best] * 1e9 + 0.50001) / 1e9
                order = np.argsort(-score, kind="stable")[:k]  # documents are in order of ids
                ids = pa.array(docs[best][order])
                out.append(pa.table({"id": pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), "score": pa.array(np.append(score[order], 0.0)),
                                     "n": pa.array([0] * len(ids) + [int(read)], pa.int64()), "at": pa.array([lo] * (len(ids) + 1))}))
        if not out:
            out.append(pa.table({"id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "at": pa.array([], pa.int64())}))
        both = pa.concat_tables(out)
        return both.drop_columns("at").add_column(0, "qid", asked["qid"].take(both["at"]))

    return run
