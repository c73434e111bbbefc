"""Phrase collocations against brute force on small texts; both ways to meet the dictionary; ranges cut anywhere."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skerry.llm import phrases

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in range(1, 5):
                for i in range(len(ws) - size + 1):
                    f[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang, c in f.items():
        cand = {p for p, k in c.items() if len(p) > 1 and k >= min_count}
        scored = []
        for p in cand:
            if any(len(q) > len(p) and 100 * c[q] >= 80 * c[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in cand):
                continue
            score, k = min((2_000_000 * c[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def listed(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    """Few words, so phrases repeat; one phrase holds a third of all places."""
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        ws = ["New York City Hall" if rnd.random() < 0.2 else rnd.choice(["the", "of", "Ärger", "ärger", "x\x00y", "z z", "new", "york", f"rare{rnd.randrange(90)}"]) for _ in range(60)]
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), "".join(w + rnd.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b"]) for w in ws)))
    rows += [("en", None), ("en", ""), (None, " . ,"), ("fr", "solo"), ("xx", "new york " * 3_000)]
    return rows, spark.createDataFrame([(k, lang, t, "w", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, word string, n int")


def test_equals_brute_force(texts, monkeypatch):
    rows, docs = texts
    monkeypatch.setattr(phrases, "BYTES", 100)
    got = listed(phrases.collocations(docs, min_count=10))
    assert got == brute(rows, 10, 2_000) and len({r[0] for r in got}) >= 4


def test_small_ranges_and_the_join(texts, monkeypatch):
    """Keys sorted few at a time, ranges that cut runs, ranges over their size, and a dictionary that is joined."""
    rows, docs = texts
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "RANGE", 40)
    monkeypatch.setattr(phrases, "HELD", 20)
    monkeypatch.setattr(phrases, "DICTIONARY", 3)
    assert listed(phrases.collocations(docs, min_count=10, top=7)) == brute(rows, 10, 7)


def test_bounded_chunks(monkeypatch):
    """However long an array of ids is, CHUNK keys or so are sorted at a time and SENT rows sent on, with the same counts."""
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "SENT", 20, raising=False)
    sorted_at_once = []
    monkeypatch.setattr(phrases, "_counted", lambda columns, own=phrases._counted: sorted_at_once.append(len(columns[0])) or own(columns))
    rnd = random.Random(9)
    arrays = [np.array([rnd.randrange(6) for _ in range(size)], np.uint32) for size in (1_003, 7, 0, 1, 150)]
    want, got = Counter(), Counter()
    for ids in arrays:
        for key in zip(*(c.tolist() for c in phrases.keys_of(ids, 4)), strict=True):
            want[b"".join(i.to_bytes(4) for i in key)] += 1
    for batch in phrases._key_counts(iter(arrays), 4):
        assert batch.num_rows <= 20
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got[key] += n
    assert got == want and max(sorted_at_once) <= 100


def test_radix_order():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, high, 5_000).astype(np.uint32) for high in (3, 200_000, 2**32, 5)]
    order = phrases.radix_order(columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert [rows[i] for i in order] == sorted(rows)


def test_large_counts_are_exact(spark):
    """Products over 64 bits."""
    key = lambda *ids: b"".join(i.to_bytes(4) for i in ids)
    big = 4 * 10**18
    p = spark.createDataFrame([(bytearray(key(1, 2)), big)], "key binary, n long")
    w = spark.createDataFrame([(bytearray(key(1)), big + 1), (bytearray(key(2)), big + 7)], "key binary, n long")
    r = phrases.weakest_cuts(p, w).first()
    assert (r["l"], r["r"], r["score"]) == (big + 1, big + 7, 2_000_000 * big // (2 * big + 8))


def test_odd_tables(cases, rows, empty):
    assert phrases.collocations(empty).count() == 0
    assert listed(phrases.collocations(cases, min_count=3)) == brute([("en", t) for _, t in rows], 3, 2_000)
