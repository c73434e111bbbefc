"""Terms spelled nearly alike: variants against all pairs, the index and searches."""

import random

from pyspark.sql import functions as F

from skerry.operators import postings
from skerry.plans.engine import Engine, SearchQuery


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(n, seed=3):
    r = random.Random(seed)
    some = {"".join(r.choice("abé") for _ in range(r.randint(1, 11))) for _ in range(n)}
    return sorted(some | {"a", "ab", "x" * 5_000, "x" * 4_999 + "y", "ab" * 8 + "c", "ab" * 8})


def test_variants_find_every_pair(spark):
    terms = words(400)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    by_variant = {}
    n_of = {}
    for r in postings.spellings(table).collect():
        by_variant.setdefault(r["variant"], set()).add(r["term"])
        n_of[r["term"]] = n_of.get(r["term"], 0) + 1
    assert max(n_of.values()) <= 37 and set(n_of) == set(terms)
    short = [t for t in terms if len(t) < 100]
    for a in short[::5] + ["b", "bab", "abababababababab"]:
        for d in (0, 1, 2):
            candidates = set().union(*(by_variant.get(v, set()) for v in postings.variants_py(a, d)))
            assert {b for b in short if edits(a, b) <= d} <= candidates, (a, d)
    assert "x" * 4_999 + "y" in set().union(*(by_variant.get(v, set()) for v in postings.variants_py("x" * 5_000, 1)))


def test_fuzzy_search(spark, tmp_path):
    rows = [(1, "the house of a friend"), (2, "two horses and a Hóuse"), (3, "a mouse"), (4, "nothing alike"), (5, "hose, hoses, housing"), (6, None), (7, "house~ house")]
    engine = Engine(spark, str(tmp_path))
    engine.build(spark.createDataFrame(rows, "doc_id int, text string"), vectors=False)
    near = lambda w, d: [(r["term"], r["df"], r["distance"]) for r in engine.fuzzy_terms(w, d).collect()]
    assert near("House", 1) == [("house", 3, 0), ("hose", 1, 1), ("mouse", 1, 1)]
    assert near("house", 2) == [("house", 3, 0), ("hose", 1, 1), ("mouse", 1, 1), ("hoses", 1, 2), ("horses", 1, 2)][:3] + sorted([("hoses", 1, 2), ("horses", 1, 2)])
    assert {t for t, _, _ in near("house", 4)} == {t for t in ("house", "hose", "mouse", "hoses", "horses", "housing", "the", "of", "two", "a", "friend", "and", "nothing", "alike") if edits(t, "house") <= 4}
    assert near("zzzzzz", 2) == []
    ids = lambda q, **kw: sorted(r["doc_id"] for r in engine.search(SearchQuery(q, mode="keyword", fuzzy=True, **kw)).collect())
    assert ids("hause~") == [1, 2, 7] and ids("hose~ NOT friend") == [2, 5, 7] and ids("hose~2 AND a") == [1, 2, 3]
    assert ids("zzzzzz~") == []
    engine.remove(spark.createDataFrame([(3,)], "doc_id int"))
    assert [t for t, _, _ in near("house", 1)] == ["house", "hose"]


def test_fuzzy_plan_reads_the_buckets_of_the_variants(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.build(spark.createDataFrame([(1, "some words to look at")], "doc_id int, text string"), vectors=False)
    near = engine._index(engine._now()).spellings
    plan = near.where(F.col("bucket").isin(1, 2) & F.col("variant").isin("words", "wods"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
