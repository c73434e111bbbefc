"""An approximate vector index: inverted lists of product-quantised vectors, ranked exactly at the end (VEC-4, SP-9).

A model is fitted on a bounded sample (rank.IVF_SAMPLE vectors by a hash of their ids): centres of
lists, and for each of SUBSPACES parts of a vector a codebook of what is left after its centre. A
row of the index is its ids, its list and one byte a part. Written by list, a search reads the
lists nearest to the query and no full vector; distance tables of the query give the REFINE * k
nearest rows by their codes, and only those are fetched and measured.

How many lists are read is fitted too: the fewest that hold TARGET of the true neighbours of
vectors of the sample. So a search is approximate by design; tests and README state its recall.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rank

SUBSPACES, WORDS = 16, 256
#: Rows ranked exactly for each of the k wanted.
REFINE = 10
#: Share of true neighbours that the lists read must hold, in the sample.
TARGET = 0.97
MAX_LISTS = 4_096
#: Vectors of the sample whose neighbours are looked for to fit the number of lists read, and neighbours of each.
ASKED, NEIGHBOURS = 200, 10


@dataclass(frozen=True)
class Model:
    centres: list[list[float]]
    codebooks: list[list[list[float]]]
    probes: int

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [("centre", i, 0, c) for i, c in enumerate(self.centres)] + [("word", m, i, w) for m, book in enumerate(self.codebooks) for i, w in enumerate(book)] + [("probes", self.probes, 0, [])]
        spark.createDataFrame(rows, "kind string, i int, j int, vector array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Model:
        rows = sorted((r["kind"], r["i"], r["j"], r["vector"]) for r in spark.read.parquet(path).collect())  # MAX_LISTS + SUBSPACES * WORDS rows
        centres = [v for k, _, _, v in rows if k == "centre"]
        books: dict[int, list] = {}
        for k, m, _, v in rows:
            if k == "word":
                books.setdefault(m, []).append(v)
        return cls(centres, [books[m] for m in sorted(books)], next(i for k, i, _, _ in rows if k == "probes"))


def _nearest(x, centres):
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def _lloyd(x, k: int, rounds: int = 8):
    """Centres of ``x``, from k of its distinct rows at even steps."""
    import numpy as np

    found = np.unique(x, axis=0)
    centres = found[np.linspace(0, len(found) - 1, min(k, len(found))).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _parts(width: int) -> list[slice]:
    import numpy as np

    return [slice(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(width), min(SUBSPACES, width)) if len(p)]


def fit(vectors: DataFrame, ids: list[str], vector: str = "embedding", lists: int | None = None) -> Model:
    """Fit a model; ``lists``: by default twice the root of the number of sampled vectors, at most MAX_LISTS. An empty table gives an empty model."""
    import numpy as np

    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(*ids).alias("_h"), *ids).orderBy("_h", *ids).limit(rank.IVF_SAMPLE)
    x = np.array([r[0] for r in rows.select(vector).collect()], np.float64)
    if not len(x):
        return Model([], [], 0)
    k = min(MAX_LISTS, lists or max(4, int(2 * len(x) ** 0.5)))
    start = x[np.random.default_rng(0).permutation(len(x))]
    centres = _lloyd(start, k)
    near = _nearest(x, centres)
    left = x - centres[near]
    books = [_lloyd(left[:, p], WORDS) for p in _parts(x.shape[1])]
    asked = x[:ASKED]
    order = np.argsort((centres * centres).sum(1) - 2 * asked @ centres.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    away = (x * x).sum(1) - 2 * asked @ x.T
    wanted = np.argsort(away, axis=1)[:, : NEIGHBOURS + 1]
    depth = np.sort(np.take_along_axis(place, near[wanted], axis=1).ravel())
    probes = int(depth[int(np.ceil(TARGET * len(depth))) - 1]) + 1
    return Model(centres.tolist(), [b.tolist() for b in books], probes)


def encode(vectors: DataFrame, model: Model, ids: list[str], vector: str = "embedding") -> DataFrame:
    """(ids, list, codes) of every row with a vector; written ``partitionBy("list")``, a search reads the lists it needs."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ids)
    centres, books = model.centres, model.codebooks

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c, words = np.array(centres), [np.array(b) for b in books]
        for batch in batches:
            if not len(batch):
                continue
            x = rank._matrix(batch.column(len(ids)))
            near = _nearest(x, c)
            left = x - c[near]
            codes = np.stack([_nearest(left[:, p], w) for p, w in zip(_parts(x.shape[1]), words, strict=True)], axis=1).astype(np.uint8)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), pa.array(near.astype(np.int32)), packed], [*ids, "list", "codes"])

    return vectors.where(F.col(vector).isNotNull()).select(*ids, vector).mapInArrow(run, f"{kinds}, list int, codes binary")


def lists_of(model: Model, query: list[float], probes: int | None = None) -> list[int]:
    """The lists that a search for ``query`` reads, nearest first."""
    import numpy as np

    c = np.array(model.centres)
    order = np.argsort((c * c).sum(1) - 2 * c @ np.array(query, np.float64)) if len(c) else []
    return [int(i) for i in order[: probes or model.probes]]


def candidates(index: DataFrame, model: Model, query: list[float], n: int, ids: list[str], probes: int | None = None) -> DataFrame:
    """The ``n`` rows nearest to the query by their codes: ids and ``rough`` (about the squared distance). No full vector is read."""
    chosen = lists_of(model, query, probes)
    kinds = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in ids)
    centres, books, wanted = model.centres, model.codebooks, [float(v) for v in query]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q, parts = np.array(wanted), _parts(len(wanted))
        tables = {}
        for k in chosen:
            left = q - np.array(centres[k])
            tables[k] = [((np.array(b) - left[p]) ** 2).sum(1) for p, b in zip(parts, books, strict=True)]
        for batch in batches:
            if not len(batch):
                continue
            lists, packed = batch.column(len(ids)).to_numpy(), batch.column(len(ids) + 1)
            first = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
            codes = np.frombuffer(packed.buffers()[2], np.uint8, len(packed) * len(parts), first).reshape(len(packed), len(parts))
            rough = np.zeros(len(packed))
            for k in np.unique(lists):
                at = lists == k
                rough[at] = sum(t[codes[at, m]] for m, t in enumerate(tables[int(k)]))
            keep = np.arange(len(rough)) if len(rough) <= n else np.flatnonzero(rough <= np.partition(rough, n - 1)[n - 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in range(len(ids))), pa.array(rough[keep])], [*ids, "rough"])

    read = index.where(F.col("list").isin(chosen)).select(*ids, "list", "codes")
    return read.mapInArrow(run, f"{kinds}, rough double").orderBy("rough", *ids).limit(n)


def knn(index: DataFrame, vectors: DataFrame, model: Model, query: list[float], k: int, ids: list[str], vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """About the k nearest rows: REFINE * k candidates by their codes, ranked by their full vectors, which alone are fetched.

    Where the lists read hold fewer candidates than that, all lists are read.
    """
    n = REFINE * k
    found = candidates(index, model, query, n, ids, probes).select(*ids).collect()
    if len(found) < n and len(lists_of(model, query, probes)) < len(model.centres):  # too few rows are left in those lists
        found = candidates(index, model, query, n, ids, len(model.centres)).select(*ids).collect()
    near = vectors
    for c in ids:  # known values reach the scan, so that it skips the rest
        near = near.where(F.col(c).isin(sorted({r[c] for r in found if r[c] is not None})))
    if len(ids) > 1:
        near = near.join(F.broadcast(vectors.sparkSession.createDataFrame(found, vectors.select(*ids).schema)), ids, "left_semi")  # REFINE * k rows
    return rank.knn(near, query, k, ids, vector)
