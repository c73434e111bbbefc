"""Mixing sources to target weights by a curriculum that varies over training.

Each source has a curve: its weight at some times between 0 (start of training) and 1 (end), linear
between them. The curve's integral says how much of the budget the source gets; its running
integral, scaled to that, is the source's cumulative demand of words over time.

1. Targets: the budget is shared by the integrals; a source stops at ``max_epochs`` times its
   size, and the excess is shared again by weight among the others until none is above (a loop of
   one small aggregation a round over the table of sources).
2. Each source is a stream: its documents in the order of a hash, again and again. A target makes
   so many whole rounds and a rest. The rest takes the first documents of the order; where the
   next one would pass the target, up to FILLS passes over its part of the stream fill the gap
   with the largest documents that still fit. Documents are never cut.
3. A copy that starts after c words of its source's stream has the training position at which
   the source's cumulative demand is c: the demand inverted (a quadratic a piece of the curve).
4. :func:`training_order` sorts the copies of all sources by position, in ranges.

Everything after the word counts works on rows of ids and numbers. Equal rows are one item with a
multiplicity before anything is shuffled. The stream of a source is dealt by hash into parts of
about PART_ROWS items, so that a source with a third of all rows is summed in many tasks; only the
parts' totals are summed source by source. The table of sources is broadcast up to
BROADCAST_SOURCES rows, beyond that it is joined by a shuffle.

Defined results: a null text has size 0; a null source is a source, last in order; a null doc_id
or a repeated one is a document like any other, equal rows are taken alike; a document of size 0
takes no words and has no position; a source without a curve, or of weight 0, has target 0; an
empty table gives an empty result; further columns are ignored. The order of equal hashes is by
doc_id and size, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, numbered, scratch

MAX_EPOCHS = 3
#: Items aimed at in each part of a source's stream.
PART_ROWS = 16_384
#: Passes that fill what is left of a target with documents that fit.
FILLS = 3
BROADCAST_SOURCES = 10_000
#: Copies of one item that are written out at a time.
_BLOCK = 10_000


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")).cast("long")


def cyclic_curves(ranked: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, as means of curves: the first falls from 1.5 to 0.5, the second stays, the third rises from 1.5 to 4.5."""
    kind = F.col("rank") % 3
    pick = lambda a, b, c: F.when(kind == 0, F.lit(a)).when(kind == 1, F.lit(b)).otherwise(F.lit(c))
    return ranked.select("source", F.array(F.lit(0.0), F.lit(1.0)).alias("at"), F.array(pick(1.5, 2.0, 1.5), pick(0.5, 2.0, 4.5)).alias("weight"))


def _pieces(at: Column, weight: Column) -> Column:
    """The pieces of a curve: start, weight there, slope, and the integral before."""

    def piece(i: Column) -> Column:
        a, b, v, w = F.get(at, i), F.get(at, i + 1), F.get(weight, i), F.get(weight, i + 1)
        return F.struct(a.alias("t"), v.alias("w"), ((w - v) / (b - a)).alias("slope"), ((b - a) * (v + w) / 2).alias("area"))

    real = F.filter(F.sequence(F.lit(0), F.greatest(F.size(at) - 2, F.lit(0))), lambda i: F.get(at, i + 1) > F.get(at, i))
    return F.transform(real, piece)


def _area(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0.0), lambda s, p: s + p["area"])


def _with_curves(sources: DataFrame, curves: DataFrame) -> DataFrame:
    own = curves.select(F.col("source").alias("_source"), _pieces(F.col("at").cast("array<double>"), F.col("weight").cast("array<double>")).alias("_p"))
    before = F.transform("_p", lambda p, i: F.struct(p["t"].alias("t"), p["w"].alias("w"), p["slope"].alias("slope"), _area(F.slice("_p", 1, i)).alias("before")))
    got = sources.join(own, F.col("source").eqNullSafe(F.col("_source")), "left")
    return got.select(*sources.columns, before.alias("pieces"), F.coalesce(_area(F.col("_p")), F.lit(0.0)).alias("omega"))


def with_targets(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """``target`` for rows with ``words`` and ``omega``: the budget by weight, at most ``max_epochs * words``, the excess shared again."""
    cap = (F.lit(max_epochs) * F.col("words")).cast("double")
    level, above = None, -1
    while True:
        share = F.lit(float("inf")) if level is None else F.when(F.col("omega") > 0, F.lit(level[0]) * F.col("omega") / F.lit(level[1])).otherwise(F.lit(0.0))
        capped = F.lit(False) if level is None else cap < share
        got = sources.agg(F.sum(F.when(~capped, F.col("omega"))).alias("w"), F.sum(F.when(capped, F.lit(max_epochs) * F.col("words"))).alias("c"), F.count(F.when(capped, 1)).alias("n")).first()
        if got["n"] == above or not got["w"]:
            level = level if got["n"] == above else None
            break
        above, level = got["n"], (float(budget - (got["c"] or 0)), float(got["w"]))
    if level is None:
        return sources.withColumn("target", F.when(F.col("omega") > 0, cap).otherwise(F.lit(0.0)))
    return sources.withColumn("target", F.when(F.col("omega") > 0, F.least(cap, F.lit(level[0]) * F.col("omega") / F.lit(level[1]))).otherwise(F.lit(0.0)))


def _order_hash(doc_id: Column, size: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _position(words_before: Column) -> Column:
    """The time at which the source's cumulative demand is ``words_before``."""
    area = words_before / F.col("target") * F.col("omega")
    piece = F.element_at(F.filter("pieces", lambda p: p["before"] <= area), -1)
    rest = area - piece["before"]
    return piece["t"] + F.when(rest > 0, 2 * rest / (piece["w"] + F.sqrt(piece["w"] * piece["w"] + 2 * piece["slope"] * rest))).otherwise(F.lit(0.0))


def _filled(placed: DataFrame) -> DataFrame:
    """Units of the rest that each item gives, pass by pass (``u0``...), and the stream offsets where they start (``s0``...)."""
    part = W.partitionBy("sid", "part")
    unit = F.greatest(F.col("size"), F.lit(1))
    own = placed.withColumn("_gap", F.greatest(F.col("rest") - F.col("before"), F.lit(0))).withColumn("_left", F.col("m"))
    start = F.col("before")
    for k in range(FILLS + 1):
        order = [F.col("h"), "doc_id", "size"] if k == 0 else [F.desc("size"), F.col("h"), "doc_id"]
        fits = F.lit(True) if k == 0 else F.col("size") <= F.col("_gap")
        mass = F.when(fits, F.col("_left") * F.col("size")).otherwise(F.lit(0))
        own = own.withColumn("_cum", F.sum(mass).over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
        own = own.withColumn("_cum", F.coalesce("_cum", F.lit(0)))
        units = F.floor((F.col("_gap") - F.col("_cum")) / unit)
        own = own.withColumn(f"u{k}", F.when(fits & (F.col("size") > 0), F.greatest(F.lit(0), F.least(units, F.col("_left")))).otherwise(F.lit(0)).cast("long"))
        own = own.withColumn(f"s{k}", start + F.col("_cum")).withColumn("_left", F.col("_left") - F.col(f"u{k}"))
        if k == 0:
            own = own.withColumn("cum", F.col("_cum"))
        own = own.withColumn("_used", F.sum(F.col(f"u{k}") * F.col("size")).over(part))
        start = F.col("before") + F.greatest(F.col("rest") - F.col("before"), F.lit(0)) - F.col("_gap")  # after what earlier passes took
        own = own.withColumn("_gap", F.col("_gap") - F.col("_used")).drop("_used")
    return own


def mix(docs: DataFrame, curves=cyclic_curves, budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken, positions (of its copies in training, ascending).

    ``curves``: (source, at array, weight array) with ascending times, or a function of (source, rank) that gives them.
    ``budget``: words of the mix; all words of ``docs`` if None.
    """
    with scratch() as keep:
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        items = keep(materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("h", _order_hash(F.col("doc_id"), F.col("size")))))
        totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.count("*").alias("n_items"))
        ranked = numbered(items.select("source").distinct(), F.col("source").asc_nulls_last())
        info = totals.join(ranked.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        info = materialize(_with_curves(info, curves(ranked) if callable(curves) else curves))
        size, n = info.agg(F.sum("words"), F.count("*")).first()
        targets = with_targets(info, budget if budget is not None else size or 0, max_epochs)
        goal = F.floor(F.col("target") + 0.5)
        rounds = F.when(F.col("words") > 0, F.floor(goal / F.col("words"))).otherwise(F.lit(0))
        plan = targets.select(F.col("source").alias("_s"), F.col("rank").alias("sid"), F.col("words").alias("source_size"), "target", "pieces", "omega", rounds.alias("rounds"), (goal - rounds * F.col("words")).alias("rest"), F.ceil(F.col("n_items") / PART_ROWS).alias("parts"))
        plan = keep(materialize(plan))
    plan = F.broadcast(plan) if n <= BROADCAST_SOURCES else plan
    rows = items.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("part", F.pmod("h", "parts"))
    sums = rows.groupBy("sid", "part").agg(F.sum(F.col("size") * F.col("m")).alias("_total"))
    before = sums.select("sid", "part", (F.sum("_total").over(W.partitionBy("sid").orderBy("part")) - F.col("_total")).alias("before"))
    own = _filled(rows.join(before, ["sid", "part"]))
    # from here one row a copy of an item
    own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(_BLOCK).cast("long"))).alias("_b"))
    own = own.select("*", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + _BLOCK, F.col("m")) - 1)).alias("_j"))
    again = F.transform(F.filter(F.sequence(F.lit(0), F.lit(max_epochs)), lambda e: e < F.col("rounds")), lambda e: e * F.col("source_size") + F.col("before") + F.col("cum") + F.col("_j") * F.col("size"))
    gone, extra = F.lit(0), F.lit(None).cast("long")
    for k in range(FILLS + 1):
        inside = (F.col("_j") >= gone) & (F.col("_j") < gone + F.col(f"u{k}"))
        extra = F.when(inside, F.col("rounds") * F.col("source_size") + F.col(f"s{k}") + (F.col("_j") - gone) * F.col("size")).otherwise(extra)
        gone = gone + F.col(f"u{k}")
    starts = F.when(F.col("size") > 0, F.concat(again, F.array_compact(F.array(extra)))).otherwise(F.array().cast("array<long>"))
    out = own.select("doc_id", "source", "size", "source_size", "target", F.transform(starts, _position).alias("positions"))
    return out.withColumn("taken", F.col("size") * F.size("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The copies of a mix in training order, range-sorted: doc_id, source, size, epoch (from 0), position."""
    copies = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("epoch", "position"))
    return copies.orderBy("position", F.col("source").asc_nulls_last(), "doc_id", "epoch")


#: The same in SQL, step by step.
SQL = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
it AS (SELECT doc_id, source, size, count(*) AS m, ('0x' || substring(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h FROM d GROUP BY doc_id, source, size),
s AS (SELECT source, sum(size * m)::BIGINT AS words, count(*) AS n_items, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM it GROUP BY source),
w AS (SELECT *, (sid % 3 + 1)::DOUBLE AS omega FROM s),
lv AS (SELECT *, ((sum(words) OVER ()) - coalesce(sum({MAX_EPOCHS} * words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS num,
  sum(omega) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den, row_number() OVER o AS k FROM w WINDOW o AS (ORDER BY words / omega, sid)),
lev AS (SELECT num, den FROM lv WHERE num * omega / den <= {MAX_EPOCHS} * words ORDER BY k LIMIT 1),
t AS (SELECT w.*, least(({MAX_EPOCHS} * words)::DOUBLE, num * omega / den) AS target FROM w, lev),
g AS (SELECT *, floor(target + 0.5::DOUBLE)::BIGINT AS goal FROM t),
p AS (SELECT *, CASE WHEN words > 0 THEN goal // words ELSE 0 END AS rounds, (n_items + {PART_ROWS - 1}) // {PART_ROWS} AS parts FROM g),
r AS (SELECT it.*, sid, words, target, omega, rounds, goal - rounds * words AS rest, h % parts AS part FROM it JOIN p ON it.source IS NOT DISTINCT FROM p.source),
b AS (SELECT sid, part, sum(t) OVER (PARTITION BY sid ORDER BY part) - t AS before FROM (SELECT sid, part, sum(size * m) AS t FROM r GROUP BY ALL)),
f0 AS (SELECT r.*, before, greatest(rest - before, 0) AS gap, m AS lft FROM r JOIN b USING (sid, part)),
c0 AS (SELECT *, coalesce(sum(lft * size) OVER (PARTITION BY sid, part ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM f0),
u0 AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least((gap - cum) // greatest(size, 1), lft)) ELSE 0 END AS u FROM c0),
{{fills}}
x AS (SELECT *, unnest(range(m)) AS j, lft FROM f{FILLS + 1}),
y AS (SELECT *, CASE WHEN size > 0 THEN rounds + CASE WHEN j < m - lft THEN 1 ELSE 0 END ELSE 0 END AS copies FROM x)
SELECT doc_id, size, words AS source_size, target, (size * copies)::BIGINT AS taken FROM y"""


def _fills_sql() -> str:
    out = []
    for k in range(1, FILLS + 2):
        out.append(f"f{k} AS (SELECT * EXCLUDE (u, cum, gap, lft), gap - sum(u * size) OVER (PARTITION BY sid, part) AS gap, lft - u AS lft FROM u{k - 1}),")
        if k <= FILLS:
            out.append(f"c{k} AS (SELECT *, coalesce(sum(CASE WHEN size <= gap THEN lft * size ELSE 0 END) OVER (PARTITION BY sid, part ORDER BY size DESC, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM f{k}),")
            out.append(f"u{k} AS (SELECT *, CASE WHEN size <= gap AND size > 0 THEN greatest(0, least((gap - cum) // greatest(size, 1), lft)) ELSE 0 END AS u FROM c{k}),")
    return "\n".join(out)


SQL = SQL.replace("{fills}", _fills_sql())
