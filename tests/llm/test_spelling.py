"""Spelling variants against brute force: all pairs compared, forms and roots by hand."""

import random
import re
import zlib
from collections import Counter, defaultdict

from skerry.llm import spelling

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, min_letters, min_count, error_every):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % error_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_letters:
                n[word] += 1
    n = {w: k for w, k in n.items() if k >= min_count}
    links = defaultdict(list)
    for w in n:
        for v in n:
            if near(w, v):
                links[w].append(v)
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v))
        if n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), k, len(links[w]), n[form[w]] if w in form else 0) for w, k in n.items())


def listed(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_pairs_of_a_dense_dictionary(spark):
    """Three letters and short words: every kind of error at every place, runs of one letter, ends of words at inner nodes."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 7))) for _ in range(600)} | {"a" * k for k in range(1, 9)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()]
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_light_edges_are_few(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(2_000)})
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    per = Counter(r["id"] for r in spelling.light_edges(df).collect())
    assert max(per.values()) <= 11  # log2 of 2,000


def test_variants_of_texts(spark):
    rnd = random.Random(7)
    base = ["garden", "gardens", "öffnung", "Morning", "silver×", "mirrored"]
    rows = []
    for i in range(400):
        ws = []
        for _ in range(30):
            w = base[min(int(rnd.expovariate(1)), 5)]
            if rnd.random() < 0.1:
                k = rnd.randrange(len(w))
                w = w[:k] + rnd.choice(["", "x", w[k] + "y"]) + w[k + 1 :]
            ws.append(w)
        rows.append((i if i % 50 else None, rnd.choice([" ", ", ", "1"]).join(ws)))
    rows += [(3, None), (4, ""), (5, "a" * 5_000 + " " + "a" * 5_001)] * 3
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = listed(spelling.group_variants(docs, min_letters=5, min_count=2, error_every=7))
    assert got == brute(rows, 5, 2, 7)
    assert any(f for _, f, *_ in got) and any(r != w for w, _, r, *_ in got)


def test_tasks_pass_on_what_they_hold(spark, rows, cases, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    assert listed(spelling.group_variants(cases, error_every=5)) == brute(rows, 6, 5, 5)


def test_roots_of_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1 if i < 37 else None) for i in range(38)] + [(100, 5), (101, None)], "id long, form long")
    assert {r["id"]: r["root"] for r in spelling.roots(df).collect()} == {i: 37 for i in range(38)} | {100: 37, 101: 101}


def test_odd_tables(empty, cases):
    assert spelling.group_variants(empty).count() == 0
    assert spelling.group_variants(cases.where("text IS NULL OR doc_id = 8")).count() == 0
