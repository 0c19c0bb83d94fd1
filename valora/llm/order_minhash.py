"""Order MinHash fingerprints with built-in functions only.

A text is a row of words, its k-mers runs of ``k`` words, each numbered among its equals. The hash of a
numbered k-mer decides its bin (top bits) and its rank there (the rest): one permutation, cut into
``BINS`` parts, stands for as many permutations. Of each bin the ``PICK`` smallest are kept, put in text order, and
hashed as a tuple. Two texts share a tuple only where they share the k-mers and their order.

A k-mer travels as one long: 40 bits of hash, 24 bits of position, so that sorting is that of plain integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import materialize, text_or_empty

K, BIN_BITS, PICK = 3, 5, 2
POSITION_BITS = 24
POSITION = (1 << POSITION_BITS) - 1
HASH = ~POSITION


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _same(x: Column, y: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0


def _numbered(v: Column) -> Column:
    """Sorted k-mers with the later ones of equal hash re-hashed with their number of equals before them."""

    def equals_before(j: Column) -> Column:
        # Equal hashes stand together: find the start of the run by doubling steps.
        steps = F.transform(F.sequence(F.ceil(F.log2(F.size(v) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda p: F.pow(F.lit(2), p).cast("int"))
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
            (j - n - step >= 0) & F.coalesce(_same(F.get(v, j - n - step), F.get(v, j)), F.lit(False)), n + step).otherwise(n))

    firsts = F.filter(v, lambda x, j: (j == 0) | ~_same(F.get(v, F.greatest(j - 1, F.lit(0))), x))
    later = F.filter(F.sequence(F.lit(1), F.size(v)), lambda j: F.coalesce(_same(F.get(v, j), F.get(v, j - 1)), F.lit(False)))
    again = F.transform(later, lambda j: F.xxhash64(F.get(v, j).bitwiseAND(F.lit(HASH)), equals_before(j)).bitwiseAND(F.lit(HASH)).bitwiseOR(
        F.get(v, j).bitwiseAND(F.lit(POSITION))))
    return F.sort_array(F.concat(firsts, again))


def _tuples(v: Column) -> Column:
    """One string for each bin that is not empty: two digits of bin, eight of the tuple's hash."""
    picked = F.filter(v, lambda x, j: (j < PICK) | (_bin(F.get(v, F.greatest(j - PICK, F.lit(0)))) != _bin(x)))

    def one(s: Column, x: Column, j: Column) -> Column:
        own = F.filter(F.slice(s, F.greatest(j - PICK + 2, F.lit(1)), F.lit(PICK)), lambda y: (_bin(y) == _bin(x)))
        placed = F.sort_array(F.transform(own, lambda y: F.shiftleft(y.bitwiseAND(F.lit(POSITION)), 64 - POSITION_BITS).bitwiseOR(
            F.shiftrightunsigned(y, POSITION_BITS))))
        kmers = F.transform(placed, lambda y: y.bitwiseAND(F.lit((1 << (64 - POSITION_BITS)) - 1)))
        return F.concat(F.lpad(F.hex(_bin(x)), 2, "0"), F.lpad(F.hex(F.xxhash64(kmers).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

    def last_of_bins(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.when(
            (j == F.size(s) - 1) | (_bin(F.get(s, j + 1)) != _bin(x)), one(s, x, j)))
        return F.array_sort(F.filter(marked, lambda t: t.isNotNull()))

    return let(picked, last_of_bins)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a whole text; empty for a text without words. Fewer than ``K`` words are one k-mer."""

    def kmers(h: Column) -> Column:
        full = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, K)]))
        found = F.when(F.size(h) >= K, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.sort_array(F.transform(found, lambda x, i: x.bitwiseAND(F.lit(HASH)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(POSITION)))))

    hashed = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.array_join(let(hashed, lambda h: let(kmers(h), lambda v: let(_numbered(v), _tuples))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that are not empty in both or either; 1 for equal fingerprints."""
    bins = lambda x: F.transform(x, lambda t: F.left(t, F.lit(2)))

    def share(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y) - F.size(F.array_intersect(bins(x), bins(y))))

    apart = let(F.struct(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y")), lambda s: share(s["x"], s["y"]))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(apart.cast("double"))


def next_ids(keys: DataFrame) -> DataFrame:
    """(key, next_key, need): each distinct key, the next one (after the last the first), and its own ``need``.

    Keys are dealt by range and numbered by partition once, in a stored table; only the first key of each
    partition is looked at across partitions.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(keys.groupBy("key").agg(F.max("need").alias("need")).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "ids")
    heads = dealt.groupBy("part").agg(F.min("key").alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"), F.min("head").over(Window.partitionBy(F.lit(1))).alias("first"))
    own = dealt.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return own.join(heads, "part").select("key", F.coalesce("next_key", "after", "first").alias("next_key"), "need")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many, or all, of
    the next text in order of id; the last id is followed by the first. A null text counts as empty. Null
    ids count as one id before all others. Of rows with equal ids the one whose beginning is smallest stands
    for them as next. Other columns are ignored. An empty table gives no rows.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("key"), text_or_empty(text_col).alias("text"))
    after = materialize(next_ids(rows.select("key", F.floor(F.length("text") / 4).alias("need"))), "ids")
    before = after.select(F.col("next_key").alias("key"), F.col("key").alias("before"), "need")
    told = rows.withColumn("fp", fingerprint(F.col("text")))
    heads = told.join(before, "key").select(F.col("before").alias("key"), F.struct(F.left("text", F.col("need").cast("int")).alias("head"), F.col("fp")).alias("n"))
    heads = heads.groupBy("key").agg(F.min("n").alias("n"))
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.left("text", size - quarter), F.left("n.head", quarter))
    out = told.join(heads, "key").select(
        F.when(F.col("key") != low, F.col("key")).alias(id_col), size.cast("long").alias("n_chars"), edited.alias("edited_text"), F.col("fp").alias("fingerprint"),
        F.col("n.fp").alias("next_fp"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return out.select(id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias(
        "near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))
