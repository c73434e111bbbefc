"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's 64-bit fingerprint has a bit where over half of its word-shingle hashes have it.
Fingerprints that differ in at most MAX_DIFF bits are linked; documents linked directly or
through others form a component, named by its least doc_id.

Exact search: the 64 bits are cut into blocks, and two fingerprints within MAX_DIFF bits agree
on all but MAX_DIFF blocks, so they meet under one of the masks that keep that many. Distinct
fingerprints are dealt by (mask, masked bits), with the fewest masks, and the fewest of their
bits, that leave runs of about RUN fingerprints (see :func:`masks`). Within such a run they are
sorted by Gray rank. LEAF neighbours are a leaf, two nodes are one upper node; a node holds the
mask of the bits that its members share and their pattern, and a child adds to its parent's only
the bits that it shares further. Pairs of nodes go down the tree level by level and carry the
differences found so far: only what the children's further bits add is counted, and over
MAX_DIFF all pairs below are pruned at once. A run emits a spanning forest of its links, never
all pairs. A run over MAX_BUCKET fingerprints is cut by hash into parts, and each pair of parts
is searched in a task of its own.

Defined results: a null or wordless text has fingerprint zero and is linked like any other;
rows that repeat a doc_id share a component if their fingerprints are linked; a null doc_id
never names a component unless all its members' are null; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import materialize, released, scratch
from .components import Forest, components

SHINGLE_WORDS = 4
SEED = 42
MAX_DIFF = 4
#: Fingerprints aimed at in a run, and in one part of a run at most.
RUN, MAX_BUCKET = 2_048, 4_096
LEAF = 8
#: Pairs of leaves that are compared at once.
_AT_ONCE = 1 << 14
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)), np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle_words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            got = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(_fingerprint_batches(shingle_words)), "doc_id long, fp long")


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(n: int, max_diff: int = MAX_DIFF, run: int = RUN) -> list[int]:
    """Masks, as signed longs, of which any two codes within ``max_diff`` bits agree on one.

    One more block than ``max_diff`` is kept, two more, and so on, until ``n`` codes spread evenly leave runs of
    4 * ``run`` at most; of the bits of these blocks as many are used as leave runs of ``run``.
    """
    for kept in range(1, 64 - max_diff):
        blocks = max_diff + kept
        edges = [64 * k // blocks for k in range(blocks + 1)]
        least = sum(sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[:kept])
        if n >> least <= 4 * run:
            break
    bits = min(least, max(0, (n - 1) // run).bit_length())
    found = []
    for chosen in combinations(range(blocks), kept):
        places = sorted((p for c in chosen for p in range(edges[c], edges[c + 1])), key=lambda p: p % 3)[:bits]
        mask = sum(1 << p for p in places)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return list(dict.fromkeys(found))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Codes in Gray order under a hierarchy of shared bit patterns.

    ``levels[0]`` are the leaves; each level holds, by node, the mask of the bits that all members share, their pattern
    under it, and for all but the top what the mask has beyond the parent's.
    """

    def __init__(self, codes: np.ndarray, leaf: int = LEAF):
        self.codes, self.leaf = codes[np.argsort(gray_rank(codes), kind="stable")], leaf
        at = np.arange(0, len(codes), leaf)
        on, any_on = np.bitwise_and.reduceat(self.codes, at), np.bitwise_or.reduceat(self.codes, at)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            mask = ~(on ^ any_on)
            self.levels.append((mask, on & mask))
            if len(on) == 1:
                break
            at = np.arange(0, len(on), 2)
            on, any_on = np.bitwise_and.reduceat(on, at), np.bitwise_or.reduceat(any_on, at)
        #: Pairs of nodes looked at, and pruned with all the pairs below them.
        self.seen = self.pruned = 0

    def leaf_pairs(self, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that may hold codes within ``max_diff`` bits."""
        i = j = apart = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            (up_mask, _), (mask, pattern) = self.levels[level + 1], self.levels[level]
            known = up_mask[i] & up_mask[j]
            i, j, apart, known = (np.repeat(x, 4) for x in (i, j, apart, known))
            i, j = 2 * i + np.tile([0, 0, 1, 1], len(i) // 4), 2 * j + np.tile([0, 1, 0, 1], len(j) // 4)
            there = (i <= j) & (j < len(mask))
            i, j, apart, known = i[there], j[there], apart[there], known[there]
            further = mask[i] & mask[j] & ~known
            apart = apart + np.bitwise_count((pattern[i] ^ pattern[j]) & further)
            near = apart <= max_diff
            self.seen += len(near)
            self.pruned += len(near) - int(near.sum())
            i, j, apart = i[near], j[near], apart[near]
        return i, j

    def close_pairs(self, max_diff: int):
        """Places (x, y), x < y, of all codes within ``max_diff`` bits, in arrays."""
        n, leaf = len(self.codes), self.leaf
        padded = np.concatenate((self.codes, np.zeros(-n % leaf, np.uint64))).reshape(-1, leaf)
        first, second = self.leaf_pairs(max_diff)
        for at in range(0, len(first), _AT_ONCE):
            i, j = first[at : at + _AT_ONCE], second[at : at + _AT_ONCE]
            pair, a, b = np.nonzero(np.bitwise_count(padded[i][:, :, None] ^ padded[j][:, None, :]) <= max_diff)
            x, y = i[pair] * leaf + a, j[pair] * leaf + b
            good = (x < y) & (y < n)
            yield x[good], y[good]


def link_bucket(codes: np.ndarray, max_diff: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of one run -> links (member, root) of a spanning forest of all pairs within ``max_diff`` bits."""
    tree = GrayTree(codes)
    codes, n = tree.codes, len(codes)
    forest = Forest(n)
    for rows, cols in tree.close_pairs(max_diff):
        for x, y in zip(rows.tolist(), cols.tolist(), strict=True):
            forest.join(x, y)
    roots = np.fromiter(map(forest.find, range(n)), np.int64, n)
    members = np.nonzero(roots != np.arange(n))[0]
    return codes[members], codes[roots[members]]


def forest_pairs(codes: np.ndarray, max_diff: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of one run -> pairs within ``max_diff`` bits that connect what all such pairs connect, nearest first."""
    tree = GrayTree(codes)
    codes, forest, found = tree.codes, Forest(len(codes)), []
    for rows, cols in tree.close_pairs(max_diff):
        order = np.argsort(np.bitwise_count(codes[rows] ^ codes[cols]), kind="stable")
        for x, y in zip(rows[order].tolist(), cols[order].tolist(), strict=True):
            if forest.find(x) != forest.find(y):
                forest.join(x, y)
                found.append((x, y))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return codes[pairs[:, 0]], codes[pairs[:, 1]]


def _link_batches(max_diff: int, link=link_bucket):
    """Over rows sorted by bucket (m, k, i, j): the links of each bucket; a bucket may span batches."""

    def emit(codes: list[np.ndarray], out: list) -> None:
        got = np.unique(np.concatenate(codes))
        if len(got) > 1:
            out.append(link(got, max_diff))

    def run(batches):
        key, codes = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.zeros(len(fps), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate(([0], np.nonzero(change)[0])).tolist()
            out: list = []
            for s, e in zip(starts, starts[1:] + [len(fps)], strict=True):
                here = tuple(c[s].item() for c in cols)
                if here != key:
                    if codes:
                        emit(codes, out)
                    key, codes = here, []
                codes.append(fps[s:e])
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        out = []
        if codes:
            emit(codes, out)
        if out:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, max_diff: int = MAX_DIFF, run: int = RUN, max_bucket: int = MAX_BUCKET, link=link_bucket) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what pairs within ``max_diff`` bits connect.

    ``link``: what makes the links of a run, :func:`forest_pairs` where each must be such a pair itself.
    """
    each = F.posexplode(F.array(*[F.lit(m) for m in masks(fps.count(), max_diff, run)]))
    dealt = fps.select("fp", each.alias("m", "mask")).select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    sizes = dealt.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / max_bucket).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cut = dealt.join(sizes, ["m", "k"]).withColumn("parts", parts).withColumn("own", own)
    cut = cut.select("m", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select("m", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return cut.repartition("m", "k", "i", "j").sortWithinPartitions("m", "k", "i", "j").mapInArrow(released(_link_batches(max_diff, link)), "a long, b long")


def components_of(found: DataFrame, max_diff: int = MAX_DIFF, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id) for every distinct fingerprint."""
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(distinct.select("fp"), max_diff, max_bucket=max_bucket)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_diff: int = MAX_DIFF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    found = materialize(fingerprints(docs, shingle_words))
    with scratch() as keep:
        named = keep(materialize(components_of(found, max_diff)))
    return found.join(named, "fp", "left").select("doc_id", to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (see :mod:`.near_copies`): the one with the least doc_id, nulls last.

    The Gray-order index of the texts' fingerprints gives the first candidates, which their shingles verify; texts
    that are alike but whose fingerprints are further apart than it reaches are found after it.
    A document is its doc_id and text: of rows that repeat both one stays, and distinct texts under
    one doc_id, or under none, are judged by their own groups.
    """
    name = "_skerry_row"
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("row").alias(name)))
    with scratch() as keep:
        kept = keep(materialize(near_copies.groups(docs, lambda codes: links(codes, link=forest_pairs)).groupBy("root").agg(first.alias("first")).select(f"first.{name}")))
    return near_copies.with_row(docs, name).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)
