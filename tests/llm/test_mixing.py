"""Mixing by a curriculum: targets by brute force, streams, positions, hot sources, odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from skerry.llm import mixing


def size_of(text):
    return len(re.findall("[^ \t\n\x0b\x0c\r]+", text or ""))


def brute_targets(words, weights, budget, most):
    """The excess shared again until no source is above its bound."""
    target, fixed = {}, set()
    while True:
        rest = budget - sum(most * words[s] for s in fixed)
        free = sum(weights[s] for s in words if s not in fixed)
        target = {s: most * words[s] if s in fixed else rest * weights[s] / free for s in words}
        above = {s for s in words if s not in fixed and target[s] > most * words[s]}
        if not above:
            return target
        fixed |= above


def by_source(rows):
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    return taken, target


@pytest.fixture(scope="module")
def mixed(spark):
    """A source with most of the words, small ones that reach their bound, one of a single long document, one of null."""
    sizes = {"a": [3] * 900 + [40] * 50, "b": [20, 30, 1, 0], "c": [2, 5], "d": [400], None: [7] * 30, "é": [11] * 9}
    rows = [(i, " ".join(["w"] * n), s, "x", 1.0) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, target double"), sizes


def test_targets_and_taken(mixed):
    docs, sizes = mixed
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = {s: sum(n) for s, n in sizes.items()}
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    want = brute_targets(words, weights, sum(words.values()), 3)
    taken, target = by_source(rows)
    assert target == pytest.approx(want)
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= (200 if s == "d" else 3)
    for r in rows:
        assert r["source_size"] == words[r["source"]] and r["taken"] == r["size"] * len(r["positions"]) <= 3 * r["size"]
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])


def test_reruns_agree(mixed):
    docs = mixed[0]
    one, two = (Counter((r["doc_id"], r["taken"], tuple(r["positions"])) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_streams_follow_the_curves(spark):
    """Over any part of training, a source's words are its demand there, to within a document."""
    docs = spark.createDataFrame([(i, "w " * 5, "falls" if i % 2 else "rises") for i in range(4_000)], "doc_id long, text string, source string")
    curves = spark.createDataFrame([("falls", [0.0, 0.5, 1.0], [3.0, 1.0, 0.0]), ("rises", [0.0, 1.0], [0.0, 3.0])], "source string, at array<double>, weight array<double>")
    copies = mixing.training_order(mixing.mix(docs, curves, budget=10_000)).collect()
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies)
    area = {"falls": lambda t: 3 * t - 2 * t * t if t <= 0.5 else 1 + (t - 0.5) - (t - 0.5) ** 2, "rises": lambda t: 1.5 * t * t}
    whole = sum(f(1) for f in area.values())
    for s, f in area.items():
        for t in (0.1, 0.3, 0.5, 0.75, 1.0):
            got = sum(r["size"] for r in copies if r["source"] == s and r["position"] < t)
            assert abs(got - 10_000 * f(t) / whole) <= 10


def test_parts_of_a_hot_source(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 1_700, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 5}") for i in range(3_000)], "doc_id long, text string, source string")
    whole = by_source(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "PART_ROWS", 100)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = mixing.mix(docs).collect()
    taken, target = by_source(rows)
    assert target == whole[1] and len(rows) == 3_000
    assert all(abs(taken[s] - target[s]) <= 13 for s in target)


def test_equal_rows(spark, monkeypatch):
    """Equal rows are one item, written out again in blocks."""
    monkeypatch.setattr(mixing, "_BLOCK", 7)
    docs = spark.createDataFrame([(1, "a b", "s")] * 100 + [(None, "a b c", "s")] * 50 + [(2, "x", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == {(1, 2): 100, (None, 3): 50, (2, 1): 1}
    taken, target = by_source(rows)
    assert taken["t"] == 3 and abs(taken["s"] - target["s"]) <= 3
    positions = [p for r in rows if r["source"] == "s" for p in r["positions"]]
    assert len(set(positions)) == len(positions)


def test_odd_tables(cases, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(cases).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], size_of(r["text"])) for r in cases.collect())
    nothing = mixing.mix(cases.where("text IS NULL OR trim(text) = ''")).collect()
    assert nothing and all(r["taken"] == 0 and r["target"] == 0 for r in nothing)
    per = defaultdict(int)
    for r in rows:
        per[r["source"]] += r["taken"]
    assert abs(per["src"] - rows[0]["target"]) <= 1
