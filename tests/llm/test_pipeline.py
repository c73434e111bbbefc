"""The pipeline's stages against what their operators say, on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skerry.llm import near_copies, packing, quality_rules, simhash

from .conftest import prose
from .test_operators import brute_dedup, brute_quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, prose(2000 + k, 120) + (" grumbleface oh grumbleface" if k % 5 == 0 else ""), "en", f"src{k % 3}", 0) for k in range(300)]
    docs += [(300 + k, docs[k][1], "en", "src0", 0) for k in range(10)] + [(400, "menu | home | us | a | b | c | d | e | f | g", "en", "src0", 0), (401, None, "en", "src0", 0)]
    docs += [(500, prose(9, 60) + " " + docs[1][1], "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def brute_rules(text):
    """The text without failing lines, or None for a rejected one, in plain Python."""
    n, *_, failed = brute_quality(text)
    lines, lost = [], 0
    for line in (text or "").split("\n"):
        words = line.split()
        share = lambda signs, line=line: 100 * sum(c in signs for c in line)
        bad = words and (
            share("#*$%&|<>") > 20 * len(words) or share("|»›•·→") > 15 * len(words) or 100 * len(re.findall("[!?][!?]", line)) > 30 * len(words)
            or re.search(r"(\.\.\.|…)\s*\Z", line) or (len(words) <= 30 and any(p in line.lower() for p in quality_rules.BOILERPLATE))
        )
        if bad:
            lost += len(words)
        else:
            lines.append(line)
    return None if failed or 100 * lost > 30 * n else "\n".join(lines)


def test_run_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, columns with clashing names, one very long text; and no rows at all."""
    base = [(k, prose(5000 + k, 100)) for k in range(40)]
    odd = [(None, prose(5100, 80)), (None, prose(5101, 80)), (None, None), (3, prose(5102, 80)), (4, base[4][1]), (50, ""), (51, None), (52, prose(5103, 30_000)), (53, base[5][1])]
    docs = [(i, t, "en", "s", 0, "a", 1, 2.0, "b") for i, t in base + odd]
    kind = "doc_id long, text string, lang string, source string, n_chars long, root string, row int, score double, spans string"
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = [r for r in got if r["piece"] == 0]
    assert sum(r["doc_id"] is None for r in whole) == 2 and {r["doc_id"] for r in whole} == {None, *range(40), 52}
    assert sum(r["doc_id"] == 3 for r in whole) == 2 and sum(r["doc_id"] == 4 for r in whole) == 1
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == [c.split()[0] for c in kind.split(", ")]
    none = tmp_path / "none"
    spark.createDataFrame([], kind).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = before, after = docs, spark.read.parquet(str(tmp_path / name))
        docs = after
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality_rules"]
    good = {r["doc_id"]: brute_rules(r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in good.items() if t is not None}
    assert ids(after) == {r["doc_id"] for r in quality_rules.judge(before).where("kept").collect()} and not {400, 401} & ids(after)
    before, after = seen["toxicity"]
    assert all(i % 5 for i in ids(after) if i < 300) and {i for i in ids(before) if i < 300 and i % 5} <= ids(after)
    before, after = seen["simhash_near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert ids(after) == {rows[k][0] for k in set(shingle_groups([t for _, t in rows]))}
    before, after = seen["substring_dedup"]
    want = {i: kept for i, _, gone, kept in brute_dedup([(r["doc_id"], r["text"]) for r in before.collect()]) if gone}
    assert {r["doc_id"]: r["text"] for r in after.collect() if r["doc_id"] in want} == {i: t for i, t in want.items() if t} and want
    text = {r["doc_id"]: r["text"] for r in after.collect()}
    assert text[500] == prose(9, 60) and all(text[r["doc_id"]] == r["text"] for r in before.collect() if r["doc_id"] != 500)
    assert ids(docs) == ids(after)
    library = Tokenizer.from_file(packing.tokenizer_path())
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in text.items()}
    packed = seen["best_fit_packing"][1].collect()
    assert Counter(i for i, n in lengths.items() for _ in range(-(-n // 2048))) == Counter(r["doc_id"] for r in packed)
    assert sum(lengths.values()) == sum(r["length"] for r in packed)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def shingle_groups(texts):
    """Brute force: the least index of each text's group at Jaccard 0.8 or more of 5-word shingles."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for k, g in enumerate(group):
        least.setdefault(g, k)
    return [least[g] for g in group]


def edited(seed: int, text: str, n: int) -> str:
    rnd, w = random.Random(seed), text.split()
    for k in rnd.sample(range(len(w)), n):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def test_near_copies_against_jaccard(spark, monkeypatch):
    texts = [prose(3000 + k, 200) for k in range(30)]
    texts += [edited(100 * k + n, texts[k], n) for k in range(30) for n in (1, 3, 4, 5, 9)]
    texts += [edited(7000 + k, prose(2999, 200), 4) for k in range(40)] + ["one two", "One  two", "one two three", None, " "]
    want = shingle_groups(texts)
    assert 30 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part, cross in ((256, 500), (2, 3)):  # whole buckets, and buckets cut into parts
        monkeypatch.setattr(near_copies, "PART", part)
        monkeypatch.setattr(near_copies, "CROSS", cross)
        assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == set(want)


def test_only_agreeing_texts_are_sent():
    """Of a bucket, the rows that agree with one of another root in another part, found by brute force."""
    rng = np.random.default_rng(3)
    for crossed in (False, True):
        base = rng.integers(0, 256, near_copies.BANDS * near_copies.ROWS).astype(np.uint8)
        rows = []
        for k in range(60):
            sig = base.copy()
            changed = rng.random(len(sig)) < rng.choice([0.05, 0.2, 0.5])
            sig[changed] = rng.integers(0, 256, int(changed.sum()))
            rows.append((int(rng.integers(0, 2)) if crossed else 0, k, int(rng.integers(80, 120)), sig.tobytes(), int(rng.integers(0, 6))))
        own, fp, n, sig, root = (list(c) for c in zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        columns = [[1] * 60, [2] * 60, [0] * 60, [int(crossed)] * 60, own, fp, n, sig, root]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list("abcdefghi"))
        got = {f for b in near_copies._wanted_batches([batch.slice(0, 25), batch.slice(25)]) for f in b.column(5).to_pylist()}
        want = set()
        for x in range(60):
            for y in range(60):
                same = sum(a == b for a, b in zip(sig[x], sig[y], strict=True))
                if root[x] != root[y] and (own[x] != own[y] or not crossed) and min(n[x], n[y]) >= 0.8 * max(n[x], n[y]) and same >= 0.65 * len(sig[x]):
                    want |= {fp[x], fp[y]}
        assert got == want and 0 < len(want) < 60


def test_near_copies_under_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (prose(4000 + k, 90) for k in range(6))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, edited(1, d, 1)), (6, edited(2, c, 1)), (2, d), (None, edited(3, d, 1)), (7, e), (7, e), (7, f)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([("None", a), ("None", b), ("5", c), ("2", d), ("7", e), ("7", f)])


def test_near_copies_come_from_the_index_of_fingerprints(spark, monkeypatch):
    """SimHash with its Gray-order index links near copies by itself, also without any bucket of minima; its pairs are verified."""
    nothing = lambda batches: iter(())
    monkeypatch.setattr(near_copies, "_forest_batches", nothing)
    monkeypatch.setattr(near_copies, "_wanted_batches", nothing)
    texts = [prose(8000 + k, 600) for k in range(20)] + [edited(k, prose(8000 + k, 600), 1) for k in range(20)]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(20)) <= got and len(got) <= 25
    monkeypatch.setattr(near_copies, "simhash_of", lambda hashes: 7)  # one fingerprint for all: nothing alike, nothing goes
    other = spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string")
    assert simhash.keep_one(other).count() == 8


def test_forest_pairs_are_near_and_connect():
    rng = np.random.default_rng(5)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for c in rng.integers(0, 1 << 63, 9, np.uint64)]))
    a, b = simhash.forest_pairs(codes)
    assert (np.bitwise_count(a ^ b) <= simhash.MAX_DIFF).all()
    members, roots = simhash.link_bucket(codes)
    assert len(a) == len(members) and set(a.tolist()) | set(b.tolist()) == set(members.tolist()) | set(roots.tolist())
