"""Document fingerprints by consistent weighted sampling (native: DataFrame functions only).

Terms are the lower-cased words of a text, weighted by how often they occur. For sample k each
term draws r and c from Gamma(2, 1) and b from U(0, 1); with weight w its level is
t = floor(ln w / r + b) and its rank c exp(-r (t + 1 - b)). The least rank of a text is its
sample. Two texts share a sample with a probability that equals the generalised Jaccard
similarity of their weighted terms (sum of minima over sum of maxima), as the rank depends on
the term and its level only.

The draws come from four uniform numbers, the halves of two hashes of the term: r b = -ln u1 and
r (1 - b) = -ln u2 are what a Gamma(2, 1) variable times b and 1 - b are (two independent
exponential ones), and c = -ln u3 u4. So exp(-r) = u1 u2, the rank is c u2 (u1 u2)^t, and a word
that occurs once (t = 0) costs one logarithm. A word as frequent in a text as in its edited text
is ranked once for both.

A fingerprint is SAMPLES samples of 16 bits, in hexadecimal; the likeness of two is the share
of samples that are equal.

Defined results: a null text counts as empty; texts without words share the fingerprint of
zeros; rows that repeat doc_id and text count as one document in the order of documents, and
each gets its result; those that repeat only doc_id are ordered by a hash of the text; a null
doc_id comes after all others; a table of one document is its own next one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, materialize, scratch, words

SAMPLES = 64
#: Documents aimed at in each range of the order, and ranges at most.
BUCKET_ROWS = 1_000
MAX_BUCKETS = 10_000
#: The sides of an edit that a term counts for.
TEXT, OTHER, BOTH = 0, 1, 2
_LEAST = -(1 << 63)


def _runs(s: Column) -> Column:
    """Sorted longs -> array of (v: a distinct value, n: how often it occurs)."""

    def counted(at: Column) -> Column:
        end = lambda j: F.coalesce(F.get(at, j + 1), F.size(s))
        return F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("v"), (end(j) - p).alias("n")))

    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True)))
    return F.when(F.size(s) == 0, F.array().cast("array<struct<v:bigint,n:int>>")).otherwise(let(starts, counted))


def _hashes(text: Column) -> Column:
    """Hashes of the words of a text, with the lowest bit free."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)))


def weighted_terms(text: Column, other: Column | None = None) -> Column:
    """Array of (h: hash of a distinct word, lw: logarithm of its count, side).

    ``side`` is TEXT for a count in ``text`` and OTHER for one in ``other``; a word as frequent in both is listed once,
    as BOTH. The lowest bit of a sorted value tells the texts apart.
    """
    both = _hashes(text) if other is None else F.concat(_hashes(text), F.transform(_hashes(other), lambda h: h.bitwiseOR(F.lit(1))))

    def sided(runs: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            odd = x["v"].bitwiseAND(F.lit(1)) == 1
            after, before = F.get(runs, i + 1), F.get(runs, i - 1)
            first = ~odd & (after["v"] == x["v"].bitwiseOR(F.lit(1))) & (after["n"] == x["n"])
            second = odd & (before["v"] == x["v"].bitwiseAND(F.lit(-2))) & (before["n"] == x["n"])
            side = F.when(first, F.lit(BOTH)).when(second, F.lit(-1)).otherwise(odd.cast("int"))
            return F.struct(x["v"].bitwiseAND(F.lit(-2)).alias("h"), F.log(x["n"].cast("double")).alias("lw"), side.alias("side"))

        return F.filter(F.transform(runs, row), lambda x: x["side"] >= 0)

    return let(let(F.sort_array(both), _runs), sided)


def _key(k: int) -> int:
    """The k-th of a sequence of signed 64-bit keys."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


def _rank(k: int) -> Column:
    """The rank of a term (columns h and lw) in sample k."""
    g1, g2 = (f"xxhash64(h ^ ({_key(2 * k + j)}L))" for j in (0, 1))
    high, low = "(shiftrightunsigned({0}, 32) + 0.5D)", "(({0} & 4294967295L) + 0.5D)"
    u1, u2 = (f"({x.format(g1)} * {2.0**-32!r}D)" for x in (high, low))
    c = f"(-ln({high.format(g2)} * {low.format(g2)} * {2.0**-64!r}D))"
    level = f"floor((ln({u1}) - lw) / ln({u1} * {u2}))"
    return F.expr(f"{c} * {u2} * IF(lw = 0D, 1D, exp({level} * ln({u1} * {u2})))")


def least_ranks(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Rows (keys, h, lw) -> (keys, ranks array<double>): the least rank in each sample; null for keys without terms."""
    least = rows.groupBy(*keys).agg(*[F.min(_rank(k)).alias(f"a{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[f"a{k}" for k in range(samples)]).alias("ranks"))


def lesser(parts: Column, samples: int = SAMPLES) -> Column:
    """An array of arrays of ranks -> the least of each sample."""
    none = F.array_repeat(F.lit(None).cast("double"), samples)
    return F.aggregate(parts, none, lambda least, x: F.zip_with(least, x, lambda a, b: F.least(a, b)))


def signature(ranks: Column) -> Column:
    """16 bits of each least rank as array<smallint>; a text without terms has zeros."""
    return F.transform(ranks, lambda a: F.when(a.isNull(), F.lit(0)).otherwise(F.xxhash64(a).bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint"))


def to_hex(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long") + 0x8000), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, th (hash of the text), sig of each distinct (doc_id, text)."""
    terms = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode_outer(weighted_terms(F.col("text"))).alias("x"))
    least = least_ranks(terms.select("doc_id", "th", "x.*"), ["doc_id", "th"], samples)
    return least.select("doc_id", "th", signature(F.col("ranks")).alias("sig"))


def neighbours(ids: DataFrame) -> DataFrame:
    """Rows (did, th, n) distinct by (did, th) -> with next_did, next_th and prev_did, prev_th, prev_n in descending, circular order.

    The order is cut into ranges of about BUCKET_ROWS rows by a sample of (did, th), so that ids may cluster or repeat.
    Within a range a window finds the neighbours; ranges, MAX_BUCKETS at most, hand their ends to those beside them.
    """
    buckets = min(MAX_BUCKETS, max(1, -(-ids.count() // BUCKET_ROWS)))
    placed = ids.select(F.struct("did", "th", "n").alias("me")).repartitionByRange(buckets, "me.did", "me.th")
    placed = materialize(placed.withColumn("b", F.spark_partition_id()))
    down = W.partitionBy("b").orderBy(F.desc("me.did"), F.desc("me.th"))
    inner = placed.withColumn("next", F.lead("me").over(down)).withColumn("prev", F.lag("me").over(down))
    ends = placed.groupBy("b").agg(F.max("me").alias("top"), F.min("me").alias("bottom"))
    row, whole = W.orderBy("b"), W.orderBy("b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lower = F.coalesce(F.lag("top").over(row), F.last("top").over(whole))
    upper = F.coalesce(F.lead("bottom").over(row), F.first("bottom").over(whole))
    ends = ends.select("b", lower.alias("lower"), upper.alias("upper"))
    full = inner.join(F.broadcast(ends), "b").withColumn("next", F.coalesce("next", "lower")).withColumn("prev", F.coalesce("prev", "upper"))
    return full.select("me.*", F.col("next.did").alias("next_did"), F.col("next.th").alias("next_th"), F.col("prev.did").alias("prev_did"), F.col("prev.th").alias("prev_th"), F.col("prev.n").alias("prev_n"))


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of the text's characters replaced by the first as many of the next document,
    in descending order of doc_id.
    """
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    ids = materialize(base.groupBy("did", "th", "doc_id").agg(F.count("*").alias("m"), F.max(F.char_length("text")).cast("long").alias("n")))
    with scratch() as keep:
        beside = keep(materialize(neighbours(ids.groupBy("did", "th").agg(F.max("n").alias("n")))))
    keyed = base.select("did", "th", "text").join(beside, ["did", "th"])
    heads = keyed.select(F.col("prev_did").alias("did"), F.col("prev_th").alias("th"), F.expr("left(text, cast(floor(prev_n / 2) as int))").alias("head")).dropDuplicates(["did", "th"])
    both = keyed.select("did", "th", "text", "n").join(heads, ["did", "th"])
    edited = F.concat(F.expr("left(text, cast(n - floor(n / 2) as int))"), F.col("head"))
    both = both.select("did", "th", "text", edited.alias("edited"))
    both = both.select("did", "th", F.sha2("edited", 256).alias("sha"), weighted_terms(F.col("text"), F.col("edited")).alias("terms"))
    terms = both.select("did", "th", "sha", F.explode_outer("terms").alias("x")).select("did", "th", "sha", "x.*")
    least = least_ranks(terms, ["did", "th", "sha", "side"], samples)
    sides = least.groupBy("did", "th", "sha").agg(F.collect_list(F.struct("side", "ranks")).alias("sides"))  # three at most
    of = lambda side: F.transform(F.filter("sides", lambda x: x["side"].isin(side, BOTH)), lambda x: x["ranks"])
    found = materialize(sides.select("did", "th", "sha", *[signature(lesser(of(side), samples)).alias(f"s{side}") for side in (TEXT, OTHER)]))
    mine = ids.join(beside.select("did", "th", "next_did", "next_th"), ["did", "th"]).join(found, ["did", "th"])
    after = found.select(F.col("did").alias("next_did"), F.col("th").alias("next_th"), F.col("s0").alias("s2"))
    out = mine.join(after, ["next_did", "next_th"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        to_hex(F.col("s0")).alias("fingerprint"),
        to_hex(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1")).alias("near_edited"),
        likeness(F.col("s0"), F.col("s2")).alias("near_next"),
    )
