"""Filters, facets, groups and sort orders (FIL-*, AGG-*, WIN-*, SRT-*, SET-*, DED-1, SP-14, SP-16, SP-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


#: Summaries that one summary is made of.
SUMMARISED = 1_000


def any_of(column: str, wanted: list[str] | None) -> Column:
    """Any requested value is there; no request lets everything pass (FIL-1, FIL-2)."""
    return F.arrays_overlap(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(True)


def year_between(year: Column, low: int | None, high: int | None) -> Column:
    """Inclusive bounds; an unknown year passes; a bound of 0 counts (FIL-3, Q-18)."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return F.coalesce(ok, F.lit(True))


def file_types(path: str, wanted: list[str] | None) -> Column:
    return T.suffix(F.col(path)).isin([w.lower() if w.startswith(".") else "." + w.lower() for w in wanted]) if wanted else F.lit(True)


def within_months(day: Column, months: int, as_of: str) -> Column:
    """Date presets relative to a given day (DATE-3)."""
    return (day > F.add_months(F.to_date(F.lit(as_of)), -months)) & (day <= F.to_date(F.lit(as_of)))


#: Rows aimed at in each range within which :func:`display_rank` numbers rows, and ranges at most.
RANGE_ROWS, MAX_RANGES = 50_000, 200


def display_rank(rows: DataFrame, first: str, tie: str) -> DataFrame:
    """Number rows from 1 in order of a numeric column and a tie-breaker, without one task for all: ranges by quantiles, numbered within, moved by the ranges' counts."""
    n = rows.count()
    parts = min(MAX_RANGES, -(-n // RANGE_ROWS))
    bounds = sorted(set(rows.approxQuantile(first, [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(first))) if bounds else F.lit(0)
    placed = rows.withColumn("_range", at)
    inside = placed.withColumn("_r", F.row_number().over(W.partitionBy("_range").orderBy(first, tie)))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # MAX_RANGES rows at most
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_range").withColumn("rank", (F.col("_before") + F.col("_r")).cast("int")).drop("_range", "_r", "_before")


def group_hits(hits: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """One row a path in order of its first hit: hits, mean score where there is one, display rank (AGG-1..AGG-3, WIN-4)."""
    own = hits.where(F.col(path).isNotNull() & (F.col(path) != ""))
    groups = own.groupBy(path).agg(F.min(order).alias("first"), F.count("*").alias("n_hits"), F.avg("score").alias("avg_score"))
    return display_rank(groups, "first", path)


def group_by_basename(hits: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """Groups as in :func:`group_hits`, by the last part of the path (AGG-2)."""
    return group_hits(hits.withColumn("basename", T.basename(F.col(path))), "basename", order)


def top_per_group(hits: DataFrame, group: str, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows of each group (WIN-1); ``overflow`` counts the others (WIN-2)."""
    w = W.partitionBy(group)
    ranked = hits.withColumn("rank_in_group", F.row_number().over(w.orderBy(*order)))
    return ranked.where(F.col("rank_in_group") <= n)


def overflow(hits: DataFrame, group: str, n: int = 3) -> DataFrame:
    return hits.groupBy(group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def filter_options(items: DataFrame) -> DataFrame:
    """Distinct tags and collections in order, and the year range (AGG-4..AGG-6); values are made distinct before any are gathered."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("values")) for k, c in enumerate(("tags", "collections"))])
    each = items.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.values").alias("value")).distinct()
    years = items.agg(F.min("year").alias("low"), F.max("year").alias("high"))
    rows = each.unionByName(years, allowMissingColumns=True)
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value"))))
    return rows.agg(listed(0).alias("tags"), listed(1).alias("collections"), F.coalesce(F.max("low"), F.lit(2000)).alias("year_min"), F.coalesce(F.max("high"), F.lit(2024)).alias("year_max"))


def dedup_content(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The least key of each distinct text (DED-1): an aggregation, so copies collapse before the shuffle."""
    return docs.groupBy(F.sha1(text).alias("sha1")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def merge_sources(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union in which rows of the right side replace those with the same key (SET-1)."""
    return left.join(right.select(key), key, "left_anti").unionByName(right, allowMissingColumns=True)


def sort_hits(hits: DataFrame, by: str, ascending: bool = True, tie: str = "path") -> DataFrame:
    """Unknown values last either way (SRT-5)."""
    c = F.col(by)
    return hits.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), tie)


def within(hits: DataFrame, earlier: DataFrame, key: list[str]) -> DataFrame:
    """Hits among an earlier search's (SP-17)."""
    return hits.join(earlier.select(*key).distinct(), key, "left_semi")


def cooccurrence(tagged: DataFrame, key: str, concept: str) -> DataFrame:
    """Documents that hold both of two concepts (SP-16). Concepts are a thesaurus' few: each document makes the pairs of its own."""
    own = tagged.groupBy(key).agg(F.array_sort(F.collect_set(concept)).alias("c"))
    pairs = own.select(F.posexplode("c").alias("i", "concept_a"), "c").select("concept_a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("concept_b"))
    return pairs.groupBy("concept_a", "concept_b").agg(F.count("*").alias("n_docs"))


def summarise(text: str, query: str | None = None, sentences: int = 3, max_words: int = 150) -> str:
    """Extractive summary of one text: the sentences whose words are frequent in it (or in the query), in order (API-4, SP-11)."""
    import re
    from collections import Counter

    from ..plans.match import split_words

    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    counts = Counter(w for s in parts for w in set(split_words(s)))
    wanted = set(split_words(query or ""))

    def value(s: str) -> float:
        own = split_words(s)
        return sum(counts[w] + (len(parts) if w in wanted else 0) for w in set(own)) / (len(own) + 5) if own else 0.0

    best = sorted(sorted(range(len(parts)), key=lambda i: (-value(parts[i]), i))[:sentences])
    words = " ".join(parts[i] for i in best).split()
    return " ".join(words[:max_words])


def summarise_many(docs: DataFrame, query: str | None = None, sentences: int = 3, max_words: int = 150, text: str = "text") -> str:
    """One extractive summary of all documents (SP-11): the summary of their summaries, in the order of ``docs``.

    More than SUMMARISED documents are a tree: a task goes through its documents, and SUMMARISED summaries at a time become
    one of the next SUMMARISED, so it passes on one; tasks' summaries are put together in the same way, as few as that go to
    the driver. No document is left out.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"s": [summarise(t or "", query, sentences, max_words) for t in batch.column(0).to_pylist()]})

    def together(batches):
        import pyarrow as pa

        held: list[str] = []
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t)
                if len(held) == SUMMARISED:
                    held = [summarise("\n".join(held), query, sentences, max_words)]
        if held:
            yield pa.RecordBatch.from_pydict({"s": [summarise("\n".join(held), query, sentences, max_words)]})

    rows = docs.select(text).mapInArrow(run, "s string")
    if docs.limit(SUMMARISED + 1).count() > SUMMARISED:
        rows = rows.mapInArrow(together, "s string")
        while (parts := rows.rdd.getNumPartitions()) > SUMMARISED:
            rows = rows.coalesce(-(-parts // SUMMARISED)).mapInArrow(together, "s string")
    return summarise("\n".join(r["s"] for r in rows.collect()), query, sentences, max_words)
