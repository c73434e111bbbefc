"""Watched folders and followed streams in an index: additions, changes, deletions, repeated batches."""

import os

from pyspark.sql import functions as F

from skerry.plans.engine import Engine, SearchQuery

TYPES = [".md", ".html"]


def put(folder, name, text, second):
    (folder / name).write_text(text, encoding="utf-8")
    os.utime(folder / name, (1_700_000_000 + second, 1_700_000_000 + second))


def found(engine, word):
    return sorted(r["path"].rsplit("/", 1)[-1] for r in engine.search(SearchQuery(word, mode="keyword")).collect())


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    engine = Engine(spark, str(tmp_path / "index"))
    look = lambda: engine.watch(str(folder), TYPES, vectors=False)
    put(folder, "a.md", "alpha stays here", 0)
    put(folder, "b [1]{x}*.md", "beta is here", 0)
    put(folder, "blank.md", "   ", 0)
    put(folder, "other.txt", "alpha of another type", 0)
    assert look() == {"added": 3, "changed": 0, "removed": 0}
    assert found(engine, "alpha") == ["a.md"] and found(engine, "beta") == ["b [1]{x}*.md"]
    first = engine.snapshot()
    assert look() == {"added": 0, "changed": 0, "removed": 0} and engine.generations() == [0]

    put(folder, "b [1]{x}*.md", "gamma came instead", 5)
    put(folder, "c.html", "<p>beta moved to</p>", 0)  # older than what is known, as a file that was moved in
    (folder / "a.md").unlink()
    assert look() == {"added": 1, "changed": 1, "removed": 1}
    assert found(engine, "alpha") == [] and found(engine, "beta") == ["c.html"] and found(engine, "gamma") == ["b [1]{x}*.md"]
    assert found(first, "alpha") == ["a.md"]

    engine.compact()
    assert look() == {"added": 0, "changed": 0, "removed": 0}
    put(folder, "blank.md", "alpha again", 9)
    (folder / "c.html").unlink()
    assert look() == {"added": 0, "changed": 1, "removed": 1}
    assert found(engine, "alpha") == ["blank.md"] and found(engine, "beta") == []
    for name in os.listdir(folder):
        (folder / name).unlink()
    assert look()["removed"] == 2 and engine.documents().count() == 0
    assert os.listdir(tmp_path / "index" / "looks") == []


def test_watching_many_files_at_once(spark, tmp_path, monkeypatch):
    from skerry.plans import engine as module

    monkeypatch.setattr(module, "FETCHED", 2)
    folder = tmp_path / "notes"
    folder.mkdir()
    for k in range(5):
        put(folder, f"n{k}.md", f"word{k} common", 0)
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.watch(str(folder), TYPES, vectors=False)["added"] == 5
    for k in range(3):
        put(folder, f"n{k}.md", f"fresh{k}", 3)
    assert engine.watch(str(folder), TYPES, vectors=False)["changed"] == 3
    assert engine.documents().where("text LIKE 'fresh%'").count() == 3 and engine.documents().count() == 5


def test_watching_keeps_other_documents(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    put(folder, "a.md", "alpha", 0)
    engine = Engine(spark, str(tmp_path / "index"))
    rows = [("lib:1", "alpha of a library", "library", "lib:1"), (f"file:{folder}/old.md", "alpha of a file since removed", "file", f"file:{folder}/old.md"), ("file:/elsewhere/a.md", "alpha of another folder", "file", "file:/elsewhere/a.md")]
    engine.build(spark.createDataFrame(rows, "doc_id string, text string, source string, path string"), vectors=False)
    assert engine.watch(str(folder), TYPES) == {"added": 1, "changed": 0, "removed": 1}
    assert sorted(r["doc_id"] for r in engine.documents().collect()) == sorted(["lib:1", "file:/elsewhere/a.md", f"file:{folder}/a.md"])


def test_followed_stream(spark, tmp_path):
    schema = "doc_id int, text string, version int, deleted boolean"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    engine = Engine(spark, str(tmp_path / "index"))

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=log):
        engine.follow(spark.readStream.schema(schema).parquet(source), checkpoint, order="version", deleted="deleted", vectors=False).awaitTermination()
        return {r["doc_id"]: r["text"] for r in engine.documents().collect()}

    send([(1, "one", 1, False), (2, "two", 1, None), (1, "one later", 2, False), (3, "three", 1, True)])
    assert run() == {1: "one later", 2: "two"}
    n = len(engine.generations())
    assert run() == {1: "one later", 2: "two"} and len(engine.generations()) == n
    send([(2, None, 2, True), (4, "four", 1, False)])
    assert run() == {1: "one later", 4: "four"}
    assert [r["doc_id"] for r in engine.search(SearchQuery("four OR two", mode="keyword", lenient=False)).collect()] == [4]

    # A crash after the commit and before the stream's own note: the batch comes again and is known.
    commits = sorted((p for p in (tmp_path / "log" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    n = len(engine.generations())
    assert run() == {1: "one later", 4: "four"} and len(engine.generations()) == n
    # Another checkpoint is another stream and takes everything.
    assert set(run(str(tmp_path / "log2"))) == {1, 4}


def test_watching_an_empty_folder(spark, tmp_path):
    folder = tmp_path / "empty"
    folder.mkdir()
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.watch(str(folder), TYPES, vectors=False) == {"added": 0, "changed": 0, "removed": 0}
    assert engine.documents().agg(F.count("*")).first()[0] == 0
    put(folder, "a.md", "alpha", 0)
    assert engine.watch(str(folder), TYPES, vectors=False)["added"] == 1 and found(engine, "alpha") == ["a.md"]
