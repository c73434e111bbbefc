"""Groups of near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same shingles count as one. SimHash comes first: the fingerprints of the sets go
through the Gray-order index of :mod:`.simhash`, and its pairs are verified by the shingles. But a
64-bit SimHash does not reach all: at 0.8 two fingerprints differ in about 10 bits, and no
set of masks that tolerates these keeps enough bits to deal by. So for what SimHash leaves apart
candidates come from MinHash: BANDS bands of ROWS minima each; a bucket whose texts are connected by now is done. A pair of
similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6, less above 0.8.

Of the texts that share a band, pairs are compared by the low bytes of all minima (a pair of
similarity 0.8 falls below LEAST_AGREE with probability under 1e-5) and by the sizes of their
sets (exact), and what is left by the shingles themselves; only those verified pairs link.
A first round verifies a spanning forest of each part of a bucket, the most alike pairs first.
In a second round, each bucket whose texts are not all connected compares every pair across its
unconnected parts; a large bucket is cut into parts, and each pair of parts has a task of its own.
Minima alone are sent there first: only a text that agrees with one of another connected part in
the same task follows with its words, and its words are dropped once no larger set is left to compare.

Defined results: a text of less than five words is one shingle; null or wordless texts are
copies of each other; case counts for nothing, as in SimHash, for ASCII letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released
from .components import components

SHINGLE_WORDS = 5
LEAST = 0.8
SEED = 42
BANDS, ROWS = 32, 5
#: Of BANDS * ROWS low bytes, so many must agree before a pair's shingles are compared.
LEAST_AGREE = 0.65
#: Texts of one part of a bucket, in the first and the second round.
PART, CROSS = 256, 500
_CHUNK = 1 << 10
_RND = np.random.default_rng(SEED)
_FLIP = _RND.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RND.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE_WORDS + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(n)), np.uint64, n))


def simhash_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of a set of hashes: a bit where over half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, ((hashes[at : at + _CHUNK] ^ _FLIP) * _TIMES).min(axis=1))
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of LEAST or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both) - 1e-9


def _sketch_batches(batches):
    import xxhash

    for batch in batches:
        fps, sizes, sims, bands, sigs = [], [], [], [], []
        for text in batch.column(2):
            hashes = shingles(text.as_py())
            low = minima(hashes)
            # Minima are kept as 32 high bits: their low byte and the band's hash read these.
            high = (low >> np.uint64(32)).astype("<u4").reshape(BANDS, ROWS)
            fps.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            sizes.append(len(hashes))
            sims.append(simhash_of(hashes))
            bands.append([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in high])
            sigs.append((high.ravel() & 255).astype(np.uint8).tobytes())
        long = lambda x: pa.array(np.array(x, np.uint64).ravel().view(np.int64))
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), long(bands))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(fps), pa.array(sizes, pa.int32()), long(sims), keys, pa.array(sigs, pa.binary())], names=["row", "doc_id", "fp", "n", "sim", "bands", "sig"])


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a hash of doc_id and text, nulls included: rows that share it are the same document."""
    i, t = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.withColumn(name, F.xxhash64(F.coalesce(i, F.lit(0)), i.isNull(), F.coalesce(t, F.lit("")), t.isNull()))


def _buckets(batches, columns: int):
    """Batches sorted by their first ``columns`` columns -> each run's key with the arrays of the other columns."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns, batch.num_columns)]
        change = np.zeros(batch.num_rows, bool)
        for c in keys:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.nonzero(change)[0])).tolist()
        for s, e in zip(starts, starts[1:] + [batch.num_rows], strict=True):
            here = tuple(c[s].item() for c in keys)
            if here != key:
                if held:
                    yield key, [np.concatenate(x) for x in zip(*held, strict=True)]
                key, held = here, []
            held.append([x[s:e] for x in rest])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)]


def _agreeing(rows: np.ndarray, cols: np.ndarray, sizes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (rows, cols), those that may be alike, with the number of agreeing minima."""
    small, large = np.minimum(sizes[rows], sizes[cols]), np.maximum(sizes[rows], sizes[cols])
    fit = small >= LEAST * large - 1e-9
    rows, cols = rows[fit], cols[fit]
    agree = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 14):
        agree[at : at + (1 << 14)] = (sigs[rows[at : at + (1 << 14)]] == sigs[cols[at : at + (1 << 14)]]).sum(axis=1)
    near = agree >= LEAST_AGREE * BANDS * ROWS
    return rows[near], cols[near], agree[near]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forest_batches(batches):
    """(m, k, part, fp, n, sig) -> the pairs of a spanning forest, the most agreeing ones first."""
    for _, (fp, n, sig) in _buckets(batches, 3):
        if len(fp) < 2:
            continue
        sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(fp), -1)
        out, up = [], list(range(len(fp)))

        def find(x: int, up=up) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        rows, cols, agree = _agreeing(*np.triu_indices(len(fp), 1), n, sigs)
        order = np.argsort(-agree, kind="stable")
        for x, y in zip(rows[order].tolist(), cols[order].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((x, y))
        if out:
            x, y = np.array(out).T
            yield _pairs(fp[x], fp[y])


def _across(own: np.ndarray, root: np.ndarray, x: int) -> np.ndarray:
    """The places after ``x`` of texts to compare with it: of other roots, and where two parts meet, of the other part."""
    other = root[x + 1 :] != root[x]
    # Where i = j all are in one part; else only pairs across the two.
    if own.min() != own.max():
        other &= own[x + 1 :] != own[x]
    return np.nonzero(other)[0] + x + 1


def _wanted_batches(batches):
    """(m, k, i, j, own, fp, n, sig, root) -> the rows that agree with one of another root in the same pair of parts."""
    for (m, k, i, j), (own, fp, n, sig, root) in _buckets(batches, 4):
        sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(fp), -1)
        wanted = np.zeros(len(fp), bool)
        for x in range(len(fp)):
            cols = _across(own, root, x)
            if wanted[x]:
                cols = cols[~wanted[cols]]
            near = _agreeing(np.full(len(cols), x), cols, n, sigs)[1]
            if len(near):
                wanted[x] = True
                wanted[near] = True
        at = np.nonzero(wanted)[0]
        if len(at):
            key = [pa.array(np.full(len(at), v, t)) for v, t in ((m, np.int32), (k, np.int64), (i, np.int32), (j, np.int32))]
            rest = [pa.array(own[at], pa.int32()), pa.array(fp[at]), pa.array(n[at], pa.int32()), pa.array(sig[at], pa.binary()), pa.array(root[at])]
            yield pa.RecordBatch.from_arrays(key + rest, names=["m", "k", "i", "j", "own", "fp", "n", "sig", "root"])


def _rest_batches(batches):
    """(m, k, i, j, own, fp, n, sig, root, text) -> the alike pairs of parts i and j that connect different roots."""
    for _, columns in _buckets(batches, 4):
        order = np.argsort(columns[2], kind="stable")
        own, fp, n, sig, root, text = (c[order] for c in columns)
        del columns
        sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(fp), -1)
        held: dict[int, np.ndarray] = {}
        for x in range(len(fp)):
            cols = _across(own, root, x)
            for y in _agreeing(np.full(len(cols), x), cols, n, sigs)[1].tolist():
                if root[x] == root[y]:
                    continue
                for z in (x, y):
                    if z not in held:
                        held[z] = shingles(text[z])
                        text[z] = None
                if alike(held[x], held[y]):
                    root[root == root[y]] = root[x]
                    yield _pairs(fp[x : x + 1], fp[y : y + 1])
            # Only later, larger sets are compared from here on.
            held.pop(x, None)
            text[x] = None


def _verify_batches(batches):
    """(a, b, text of a, text of b), sorted by b -> the pairs that are alike."""
    last, held = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            if b[k] != last:
                last, held = b[k], shingles(y.as_py())
            if alike(shingles(x.as_py()), held):
                good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text) of the fingerprints ``wanted`` (fp)."""
    rows = wanted.distinct().join(reps.select("fp", "row"), "fp")
    return materialize(with_row(docs.select("doc_id", "text"), "row").join(rows, "row").dropDuplicates(["fp"]).select("fp", F.col("text").cast("string").alias("text")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The alike ones of ``pairs`` (a, b)."""
    left, right = texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").sortWithinPartitions("b").mapInArrow(released(_verify_batches), "a long, b long")


def _named(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) of every text; texts that ``links`` (a, b) connect share a root."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    return materialize(reps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def _merged(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` (fp, root) after further links (a, b): only the roots that these bring together are looked at."""
    left, right = rooted.select(F.col("fp").alias("a"), F.col("root").alias("ra")), rooted.select(F.col("fp").alias("b"), F.col("root").alias("rb"))
    met = links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots = components(met).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return materialize(rooted.join(roots, "root", "left").select("fp", F.coalesce("last", "root").alias("root")))


def _by_simhash(docs: DataFrame, reps: DataFrame, near) -> DataFrame:
    """The alike ones of the pairs (a, b) of texts that SimHash brings together: with one fingerprint, or with near ones."""
    coded = materialize(reps.groupBy("sim").agg(F.min("fp").alias("fp")))
    same = reps.join(coded.select("sim", F.col("fp").alias("first")), "sim").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    found = near(coded.select(F.col("sim").alias("fp"))).distinct()
    left, right = coded.select(F.col("sim").alias("a"), F.col("fp").alias("x")), coded.select(F.col("sim").alias("b"), F.col("fp").alias("y"))
    met = materialize(same.unionByName(found.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    return materialize(_verified(met, _texts(docs, reps, met.select(F.explode(F.array("a", "b")).alias("fp")))))


def _open(shared: DataFrame, rooted: DataFrame) -> DataFrame:
    """The buckets (m, k) of ``shared`` whose texts are not all connected; ``rooted`` names each text's root."""
    return shared.join(rooted, "fp").groupBy("m", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("m", "k")


def groups(docs: DataFrame, near) -> DataFrame:
    """row (see :func:`with_row`), doc_id and root of every row of ``docs``; rows of one group of near copies share a root.

    ``near``: distinct SimHash fingerprints (fp) -> pairs (a, b) of near ones.
    """
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    found = materialize(rows.select("row", "doc_id", "text").mapInArrow(released(_sketch_batches), "row long, doc_id long, fp long, n int, sim long, bands array<long>, sig binary"))
    reps = materialize(found.groupBy("fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    dealt = reps.select("fp", F.posexplode("bands").alias("m", "k"))
    sizes = dealt.groupBy("m", "k").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(dealt.join(sizes, ["m", "k"]))
    rooted = _named(reps, _by_simhash(docs, reps, near))
    parts = F.ceil(F.col("members") / PART).cast("int")
    first = shared.join(_open(shared, rooted), ["m", "k"]).withColumn("part", F.pmod(F.xxhash64("m", "fp"), parts).cast("int")).join(reps.select("fp", "n", "sig"), "fp")
    first = first.select("m", "k", "part", "fp", "n", "sig").repartition("m", "k", "part").sortWithinPartitions("m", "k", "part")
    tried = materialize(first.mapInArrow(released(_forest_batches), "a long, b long").distinct())
    rooted = _merged(rooted, _verified(tried, _texts(docs, reps, tried.select(F.explode(F.array("a", "b")).alias("fp")))))
    # Second round: buckets whose texts are not all connected.
    unsettled = materialize(shared.join(rooted, "fp").join(_open(shared, rooted), ["m", "k"]))
    cut = unsettled.withColumn("parts", F.ceil(F.col("members") / CROSS).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(reps.select("fp", "n", "sig"), "fp")
    block = ["m", "k", "i", "j"]
    cut = cut.select("m", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "n", "sig", "root")
    cut = cut.repartition(*block).sortWithinPartitions(*block)
    wanted = materialize(cut.mapInArrow(released(_wanted_batches), "m int, k long, i int, j int, own int, fp long, n int, sig binary, root long"))
    whole = wanted.join(_texts(docs, reps, wanted.select("fp")), "fp").select(*wanted.columns, F.coalesce("text", F.lit("")).alias("text"))
    cut = whole.repartition(*block).sortWithinPartitions(*block)
    named = _merged(rooted, cut.mapInArrow(released(_rest_batches), "a long, b long"))
    return found.select("row", "doc_id", "fp").join(named, "fp").select("row", "doc_id", "root")
