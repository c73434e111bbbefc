"""Posting lists, early stop, segments and generations of the engine."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import ivf, postings, rank
from skerry.plans import match
from skerry.plans.engine import Engine, SearchQuery

from test_match import QUERIES, ROWS


def segment_index(spark, rows, folder, monkeypatch=None, **bits):
    chunks = spark.createDataFrame([(0, i, f"d{i // 3}", i, t) for i, t in enumerate(rows)], "seg int, row long, doc_id string, chunk_id int, text string")
    chunks = chunks.withColumn("tokens", T.tokens(F.col("text")))
    postings.write(chunks, folder, 8)
    n, total = chunks.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    return chunks, postings.Index(spark, postings.read(spark, folder, "string"), spark.read.parquet(f"{folder}/terms"), 8, n, total / n)


def test_same_hits_and_scores_as_a_scan(spark, tmp_path):
    """All conformance queries: hits by the compiled predicate, scores by the scan of token arrays."""
    chunks, index = segment_index(spark, ROWS, str(tmp_path))
    asked = {}
    for q in QUERIES:
        try:
            asked[q] = match.parse(q)
        except match.QuerySyntaxError:
            continue
    cols = [match.compile_match(n, F.col("tokens")).alias(f"q{i}") for i, n in enumerate(asked.values())]
    table = chunks.select("row", *cols).collect()
    wanted = [postings._wanted(n) for n in asked.values()]
    grouped, at = index.places(sorted({t for w in wanted for t in w[0]}), sorted({p for w in wanted for p in w[1]}))
    cols = [match.compile_places(n, lambda t, p: at[(t, p)]).alias(f"q{i}") for i, n in enumerate(asked.values())]
    got = grouped.select("row", *cols).collect()
    for i, q in enumerate(asked):
        assert {r["row"] for r in got if r[f"q{i}"]} == {r["row"] for r in table if r[f"q{i}"]}, q
    for q in ("alpha", "alpha OR beta NOT gamma", '"the cat cat"', "cat the"):
        node = match.parse(q)
        scores = {r["row"]: r["score"] for r in rank.bm25(chunks, match.terms_of(node), ["row"]).collect()}
        got = {r["row"]: r["score"] for r in index.search(node).collect()}
        assert got and got == pytest.approx({i: scores[i] for i in got}), q


def test_wide_prefix(spark, tmp_path, monkeypatch):
    chunks, index = segment_index(spark, [f"w{i} common w{i * 7 % 50}x" for i in range(90)], str(tmp_path))
    node = match.parse("w* NOT w1*")
    want = {r["row"] for r in chunks.where(match.compile_match(node, F.col("tokens"))).collect()}
    assert {r["row"] for r in index.search(node).collect()} == want
    monkeypatch.setattr(postings, "MAX_EXPANSION", 5)
    assert {r["row"] for r in index.search(node).collect()} == want


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    """Blocks of 4 chunks; the k best are those of a full evaluation, ties with the last included, and most blocks are skipped."""
    monkeypatch.setattr(postings, "BLOCK_BITS", 2)
    monkeypatch.setattr(postings, "FIRST", 3)
    rnd = random.Random(4)
    rows = [" ".join(["cat"] * (rnd.randint(1, 9) if rnd.random() < 0.1 else 1) + ["pad"] * rnd.randint(0, 30) + ["dog"] * (rnd.random() < 0.3)) for _ in range(600)]
    _, index = segment_index(spark, rows, str(tmp_path))
    for text, k in (("cat", 5), ("cat NOT dog", 3), ("cat OR dog", 10), ("zebra cat", 3)):
        node, told = match.parse(text), {}
        whole = sorted((r["score"] for r in index.search(node).collect()), reverse=True)[:k]
        got = sorted((r["score"] for r in index.top(node, k, told=told).collect()), reverse=True)
        assert got[:k] == pytest.approx(whole), text
        if text == "cat":
            assert told["blocks"] == 150 and told["read"] <= 40
        if text == "zebra cat":
            assert told["blocks"] == 0


def test_plans_read_the_buckets_of_the_terms(spark, tmp_path):
    _, index = segment_index(spark, ROWS, str(tmp_path))
    node = match.parse("alpha NOT beta")
    plan = index.hits(node, {"alpha": 1.0, "beta": 1.0})._jdf.queryExecution().executedPlan().toString()
    buckets = {postings.bucket_py(t, 8) for t in ("alpha", "beta")}
    assert "PartitionFilters: [bucket" in plan and all(str(b) in plan.split("PartitionFilters")[1].split("]")[0] for b in buckets) and "PushedFilters: [In(term" in plan


KIND = "doc_id string, text string, year int"


def test_updates_write_what_changed(spark, tmp_path):
    """Readers stay at their generation, bytes grow with the change, scores are those of a new index, compaction and vacuum keep results."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = {f"d{i}": " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 200))) for i in range(60)}
    frame = lambda: spark.createDataFrame([(k, t, 1) for k, t in rows.items()], KIND)
    e = Engine(spark, str(tmp_path / "index"))
    e.build(frame())
    old, first = e.snapshot(), e.status()["bytes"]
    ask = SearchQuery("w1 OR w2 NOT w3", mode="keyword", top_k=15)
    hits = lambda x: [(r["doc_id"], r["chunk_id"], round(r["score"], 9), r["snippet"]) for r in x.search(ask).collect()]
    was = hits(e)
    rows["d1"] = "w1 w1 w2"
    del rows["d2"]
    rows["new"] = "w2 w1 w9"
    e.update(frame())
    assert e.status()["segments"] == 2 and e.status()["bytes"] - first < 0.5 * first
    fresh = Engine(spark, str(tmp_path / "fresh"))
    fresh.build(frame())
    assert hits(e) == hits(fresh) != was == hits(old)
    assert e.status()["total_chunks"] == fresh.status()["total_chunks"] == e.chunks().count() and e.status()["digest"] == fresh.status()["digest"]
    got = lambda x, mode, fusion: [(r["doc_id"], r["chunk_id"], round(r["score"], 9)) for r in x.search(SearchQuery("w1 w2", mode=mode, fusion=fusion, top_k=8)).collect()]
    for mode, fusion in (("hybrid", "rrf"), ("hybrid", "weighted")):
        assert got(e, mode, fusion) == got(fresh, mode, fusion)
    e.remove(spark.createDataFrame([("new",), ("unknown",)], "doc_id string"))
    del rows["new"]
    e.add(frame().where("doc_id = 'd5'").withColumn("text", F.lit("w1 only")))
    rows["d5"] = "w1 only"
    again = Engine(spark, str(tmp_path / "again"))
    again.build(frame())
    assert hits(e) == hits(again)
    e.compact()
    assert hits(e) == hits(again) and e.status()["segments"] == 1 and hits(old) == was
    assert e.vacuum() == 4 and hits(e) == hits(again)
    with pytest.raises(FileNotFoundError):
        old.search(ask)


def test_two_writers(spark, tmp_path):
    """The second of two commits on one generation fails, and the index is that of the first."""
    docs = spark.createDataFrame([("a", "one", 1)], KIND)
    e = Engine(spark, str(tmp_path / "index"))
    e.build(docs)
    stale = e._now()
    e.add(spark.createDataFrame([("b", "two", 1)], KIND))
    with pytest.raises(RuntimeError):
        e._finish(stale | {"generation": 1})
    assert {r["doc_id"] for r in e.documents().collect()} == {"a", "b"}


def test_weighted_fusion_is_that_of_all_chunks(spark, tmp_path):
    """The order does not depend on how many hits are asked for."""
    rnd = random.Random(2)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(rnd.choice(["cat", "dog", "emu", "fox"]) for _ in range(rnd.randint(1, 12))), 1) for i in range(90)], KIND)
    e = Engine(spark, str(tmp_path / "index"))
    e.build(docs)
    order = lambda k: [(r["doc_id"], round(r["score"], 9)) for r in e.search(SearchQuery("cat", fusion="weighted", top_k=k, alpha=0.7)).collect()]
    assert order(90)[:3] == order(3)
    assert len(order(90)) == 90


def test_empty_and_odd_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    e.build(spark.createDataFrame([], KIND))
    assert e.search(SearchQuery("x", mode="keyword")).count() == 0 and e.search(SearchQuery("x")).count() == 0
    e.add(spark.createDataFrame([("a", None, None), ("b", "", 1), ("c", " ?! ", 2), ("d", "x " * 3_000, 3)], KIND))
    assert {r["doc_id"] for r in e.search(SearchQuery("x", mode="keyword", top_k=50)).collect()} == {"d"}
    assert e.status()["total_chunks"] == e.chunks().count() and e.documents().count() == 4


def test_product_quantised_lists(spark, tmp_path, sf):
    """Clustered vectors: few lists are read, few full vectors are measured, and recall at 10 is at least 0.9; also on the given table."""
    rnd = random.Random(8)
    rows = [(k, [rnd.gauss((k * 7919 % 40) * (1 if i % 2 else -0.5), 1) for i in range(24)]) for k in range(3_000)] + [(9_999, None)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for v, share in ((made, 0.25), (spark.read.parquet(f"{sf}/embeddings.parquet"), 1)):
        model = ivf.fit(v, ["vec_id"])
        path = str(tmp_path / f"lists{share}")
        model.write(spark, path + "-model")
        assert ivf.Model.read(spark, path + "-model") == model
        ivf.encode(v, model, ["vec_id"]).write.partitionBy("list").parquet(path)
        index, n = spark.read.parquet(path), v.where("embedding IS NOT NULL").count()
        assert index.count() == n
        hit, read = 0, 0
        asked = [r["embedding"] for r in v.where("vec_id % 61 = 0").limit(6).collect()]
        for q in asked:
            want = {r["vec_id"] for r in rank.knn(v, q, 10, ["vec_id"]).collect()}
            got = ivf.knn(index, v, model, q, 10, ["vec_id"]).collect()
            assert [r["distance"] for r in got] == sorted(r["distance"] for r in got)
            hit += len(want & {r["vec_id"] for r in got})
            read += index.where(F.col("list").isin(ivf.lists_of(model, q))).count()
        assert hit >= 0.9 * 10 * len(asked) and read <= share * n * len(asked)
    plan = ivf.candidates(index, model, asked[0], 10, ["vec_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "embedding" not in plan
    assert ivf.fit(made.limit(0), ["vec_id"]).probes == 0


def test_engine_with_codes(spark, tmp_path):
    rnd = random.Random(3)
    topics = [["cat", "purr", "milk"], ["dog", "bark", "bone"], ["fox", "den", "red"]]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(rnd.choice(topics[i % 3]) for _ in range(20)), i) for i in range(120)], KIND)
    e = Engine(spark, str(tmp_path / "index"), index="ivf_pq")
    e.build(docs)
    exact = Engine(spark, str(tmp_path / "exact"))
    exact.build(docs)
    assert e.status()["index_type"] == "ivf_pq" and Engine.open(spark, e.folder).index == "ivf_pq"
    more = spark.createDataFrame([("new", "dog bark bone dog bark bone", 5), ("d001", "fox", 1)], KIND)
    for x in (e, exact):
        x.add(more)
    ask = SearchQuery("dog bark bone", mode="semantic", top_k=10)
    got, want = ([r["doc_id"] for r in x.search(ask).collect()] for x in (e, exact))
    assert got[0] == want[0] == "new" and len(set(got) & set(want)) >= 9
    assert [r["doc_id"] for r in e.search(SearchQuery("dog", mode="semantic", year_max=0, top_k=3)).collect()] == ["d000"]
    e.remove(more.where("doc_id = 'new'"))
    assert "new" not in {r["doc_id"] for r in e.search(ask).collect()}
    e.vacuum()
    assert len(e.search(SearchQuery("dog", top_k=5)).collect()) == 5


def test_what_a_chunk_is_is_kept_once_a_block(spark, tmp_path):
    """Posting rows of terms hold places only; ids and lengths are in one row a block, whatever the number of terms."""
    _, index = segment_index(spark, [f"w{i} common w{i * 7 % 50}x" for i in range(90)], str(tmp_path))
    rows = index.postings.collect()
    assert "rows" not in index.postings.columns and all(r["docs"] is None and r["chunks"] is None and r["dls"] is None for r in rows if r["term"] is not None)
    own = [r for r in rows if r["term"] is None]
    assert sum(len(r["docs"]) for r in own) == 90 and {r["bucket"] for r in own} == {postings.OWN}
    assert postings.spellings(spark.createDataFrame([("abcdefghijk",)], "term string")).count() == 3


def test_a_stream_moves_texts_of_repeated_documents_only(spark, tmp_path):
    """Of rows of one document the last counts; null and single ids stay as they are."""
    rows = [("a", "old text", 1), ("a", "new text", 2), ("b", "single", 1), (None, "no id", 1), (None, "no id later", 2)]
    spark.createDataFrame(rows, "doc_id string, text string, at int").write.parquet(f"{tmp_path}/in")
    e = Engine(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema("doc_id string, text string, at int").parquet(f"{tmp_path}/in")
    e.follow(stream, str(tmp_path / "log"), order="at", vectors=False).awaitTermination()
    assert {(r["doc_id"], r["text"]) for r in e.documents().collect()} == {("a", "new text"), ("b", "single"), (None, "no id later")}
