"""Vectors, BM25 and fusion (TR-5, VEC-*, FTS-15, HYB-*, LIM-1, SP-9)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Queries compared with the whole table in one pass: a stated query set, at most this many.
MAX_QUERIES = 10_000
DIMENSIONS = 384


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision (MATH-2)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _matrix(column):
    """An Arrow list column without nulls as a matrix of doubles."""
    import numpy as np
    import pyarrow.compute as pc

    flat = np.asarray(pc.list_flatten(column), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _measured(x, q, metric: str):
    """Distances of the rows of ``x`` from ``q``: squared L2, or 1 - cosine (null where a vector is zero)."""
    import numpy as np

    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    norm = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    return 1 - np.divide(x @ q, norm, out=np.full(len(x), np.nan), where=norm > 0)


def distances(vectors: DataFrame, query: list[float], ids: list[str], vector: str = "embedding", metric: str = "l2", k: int | None = None) -> DataFrame:
    """The distance of every row with a vector, by Arrow batches; with ``k``, of a batch only the rows that may be among the k nearest."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ids)
    wanted = [float(x) for x in query]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q = np.array(wanted, np.float64)
        for batch in batches:
            d = _measured(_matrix(batch.column(len(ids))), q, metric) if len(batch) else np.zeros(0)
            keep = np.arange(len(d))
            if k is not None and len(d) > k:
                keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # equal distances stay, the id decides among them later
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(keep)) for i in range(len(ids))), pa.array(d[keep])], [*ids, "distance"])

    return vectors.where(F.col(vector).isNotNull()).select(*ids, vector).mapInArrow(run, f"{kinds}, distance double")


def knn(vectors: DataFrame, query: list[float], k: int, ids: list[str], vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows by squared L2 (or cosine distance), ties by id; at most as many as there are (VEC-2, VEC-5, Q-3). No shuffle of the table."""
    got = distances(vectors, query, ids, vector, metric, k).orderBy("distance", *ids).limit(k)
    return got.withColumn("similarity", 1 - F.col("distance") / 2 if metric == "l2" else 1 - F.col("distance"))


#: Rows of the table that are compared with all queries of a pass at a time.
BATCH_ROWS = 2_000


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, ids: list[str], query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_vector", digits: int | None = None) -> DataFrame:
    """The k nearest rows of each of a stated set of queries (VEC-3), by the distance as it is or rounded to ``digits``.

    The set is counted and goes to the tasks MAX_QUERIES at a time, as a matrix. A task multiplies it with BATCH_ROWS rows at
    a time and keeps the k nearest for each query, so it passes on k rows a query; a window over those gives the ranks.
    The product only tells which rows may be near: their distances are taken from the differences.
    """
    id_type = queries.schema[query_id].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in ids)
    passes = max(1, -(-queries.count() // MAX_QUERIES))
    found = None
    for p in range(passes):
        part = queries.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p) if passes > 1 else queries
        block = part.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).toArrow()
        near = vectors.where(F.col(vector).isNotNull()).select(*ids, vector).mapInArrow(_nearest_of_block(block, ids, k, digits), f"`{query_id}` {id_type}, {kinds}, distance double")
        best = near.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy("distance", *ids))).where(F.col("rank") <= k)
        best = best.select(query_id, *ids, "distance", "rank")
        found = best if found is None else found.unionByName(best)
    return found


def _nearest_of_block(block, ids: list[str], k: int, digits: int | None):
    n_ids = len(ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        queries = _matrix(block.column(1).combine_chunks())
        lengths = (queries * queries).sum(1)
        held = None  # query, row of ids, distance
        for batch in batches:
            for start in range(0, len(batch) if len(queries) else 0, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                x = _matrix(rows.column(n_ids))
                rough = (x * x).sum(1)[:, None] - 2 * x @ queries.T + lengths
                last = np.partition(rough, k - 1, axis=0)[k - 1] if len(x) > k else np.full(len(queries), np.inf)
                slack = 1e-9 * (1 + lengths) + (0 if digits is None else 10.0**-digits)
                at, of = np.nonzero(rough <= last + slack)
                d = np.concatenate([((x[at[i : i + 50_000]] - queries[of[i : i + 50_000]]) ** 2).sum(1) for i in range(0, len(at), 50_000)] or [np.zeros(0)])
                d = d if digits is None else np.round(d, digits)
                new = pa.table([pa.array(of), *(rows.column(i).take(pa.array(at)) for i in range(n_ids)), pa.array(d)], names=["q", *(f"i{i}" for i in range(n_ids)), "d"])
                held = new if held is None else pa.concat_tables([held, new])
                if len(held) > 4 * k * len(queries) + 100_000:
                    held = _first_of_each(held, n_ids, k)
        if held is not None:
            held = _first_of_each(held, n_ids, k)
            out = [pc.take(block.column(0).combine_chunks(), held["q"].combine_chunks()), *(held[f"i{i}"].combine_chunks() for i in range(n_ids)), held["d"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(out, [block.column_names[0], *ids, "distance"])

    return run


def _first_of_each(held, n_ids: int, k: int):
    """The k first rows of each query in order of distance and ids."""
    import numpy as np
    import pyarrow as pa

    held = held.sort_by([("q", "ascending"), ("d", "ascending"), *((f"i{i}", "ascending") for i in range(n_ids))])
    q = held["q"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
    return held.take(pa.array(np.flatnonzero(place < k)))


#: Vectors on which the lists' centres are fitted.
IVF_SAMPLE = 20_000


def ivf_centres(vectors: DataFrame, lists: int, ids: list[str], vector: str = "embedding", rounds: int = 8) -> list[list[float]]:
    """Centres of the lists of an inverted-file index (VEC-4): Lloyd's rounds on the IVF_SAMPLE first vectors by a hash of their ids."""
    import numpy as np

    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(*ids).alias("_h"), *ids).orderBy("_h", *ids).limit(IVF_SAMPLE)
    x = np.array([r[0] for r in rows.select(vector).collect()], np.float64)
    if not len(x):
        return []
    centres = np.unique(x[: 4 * lists], axis=0)[:: max(1, len(np.unique(x[: 4 * lists], axis=0)) // lists)][:lists]
    for _ in range(rounds):
        nearest = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.array([x[nearest == k].mean(0) if (nearest == k).any() else c for k, c in enumerate(centres)])
    return centres.tolist()


def ivf_index(vectors: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Every row with its ``list`` (the nearest centre) and its distance from it; written ``partitionBy("list")``, a search reads the lists it needs."""
    @F.pandas_udf("list int, off double")
    def assign(batch):
        import numpy as np
        import pandas as pd

        c = np.array(centres, np.float64)
        x = np.array(batch.tolist(), np.float64).reshape(len(batch), -1)
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        k = d.argmin(1)
        return pd.DataFrame({"list": k.astype("int32"), "off": np.sqrt(((x - c[k]) ** 2).sum(1))})

    return vectors.where(F.col(vector).isNotNull()).withColumn("_a", assign(vector)).select("*", "_a.list", "_a.off").drop("_a")


def ivf_knn(index: DataFrame, centres: list[list[float]], query: list[float], k: int, ids: list[str], vector: str = "embedding", probes: int = 4, exact: bool = True) -> DataFrame:
    """The k nearest rows from the ``probes`` nearest lists, ranked by their full vectors (VEC-4).

    With ``exact``, further lists follow that could hold a nearer row: those whose centre's distance, less the list's
    radius, is within the k-th distance found. Lists of a bounded number have their radii gathered.
    """
    import math

    away = [math.dist(query, c) for c in centres]
    order = sorted(range(len(centres)), key=away.__getitem__)
    chosen = order[:probes]
    first = knn(index.where(F.col("list").isin(chosen)), query, k, ids, vector)
    if not exact or len(chosen) == len(order):
        return first
    found = [r["distance"] for r in first.collect()]
    reach = math.sqrt(max(found)) + 1e-6 if len(found) == k else math.inf
    radius = {r["list"]: r["r"] for r in index.groupBy("list").agg(F.max("off").alias("r")).collect()}
    more = [c for c in order if c in radius and (c in chosen or away[c] - radius[c] <= reach)]
    return knn(index.where(F.col("list").isin(more)), query, k, ids, vector) if len(more) > len(chosen) else first


def quantise(vector: Column) -> Column:
    """Struct of scale and bytes: 127 steps up to the largest magnitude (SP-9)."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("codes"))


def dequantise(q: Column) -> Column:
    return F.transform(q["codes"], lambda x: x.cast("double") * q["scale"])


def hash_buckets(tokens: Column, dimensions: int = DIMENSIONS) -> Column:
    """The dimension of each token: its md5's first six digits, modulo."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("long") % dimensions).cast("int"))


def hash_embedding(docs: DataFrame, key: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Deterministic default embedding: counts of hashed tokens, scaled to unit length; sparse rows (key, dim, weight)."""
    hit = docs.select(*key, F.explode(hash_buckets(T.tokens(F.col(text)), dimensions)).alias("dim")).groupBy(*key, "dim").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(*key)).cast("double"))
    return hit.select(*key, "dim", (F.col("n") / norm).alias("weight"))


def embed(docs: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """Add ``embedding`` by a model that maps a batch of texts to vectors (TR-5)."""
    from pyspark.sql import types as types

    @F.pandas_udf(types.ArrayType(types.FloatType()))
    def run(texts):
        import pandas as pd

        return pd.Series([list(map(float, v)) for v in embedder([t or "" for t in texts])])

    return docs.withColumn("embedding", run(text))


def embedder(name: str) -> Callable[[list[str]], list[list[float]]]:
    """The function of a named model: ``md5-hash-N``, or a sentence-embedding model where that optional package is there."""
    if m := re.fullmatch(r"md5-hash-([0-9]+)", name):
        return hash_embedder(int(m[1]))
    models: dict = {}

    def run(texts: list[str]) -> list[list[float]]:
        if not models:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError(f"the embedding model {name} needs the optional package sentence-transformers") from e
            models[name] = SentenceTransformer(name)
        return models[name].encode(texts, normalize_embeddings=True).tolist()

    return run


def hash_embedder(dimensions: int = DIMENSIONS) -> Callable[[list[str]], list[list[float]]]:
    """The default embedding as a function of a batch of texts."""

    def run(texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        from ..plans.match import split_words

        known: dict[str, int] = {}  # buckets of the words of a batch
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for t in split_words(text):
                if t not in known:
                    known[t] = int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dimensions
                v[known[t]] += 1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return run


def bm25(docs: DataFrame, terms: list[str], key: list[str], tokens: str = "tokens", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of the rows that hold a term: ln(1 + (N - df + 0.5) / (df + 0.5)) times saturated frequency.

    Corpus statistics are one aggregation over the token arrays; frequencies are counted in place, so nothing is exploded.
    """
    terms = sorted(set(terms))
    tf = [F.size(_having(tokens, t)).cast("double") for t in terms]
    counted = docs.select(*key, F.size(tokens).cast("double").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    any_hit = F.lit(False)
    for i in range(len(terms)):
        df, n = stats[f"df{i}"] or 0.0, stats["n"]
        f = F.col(f"tf{i}")
        idf = F.log(F.lit(1.0) + F.lit((n - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (k1 + 1) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
        any_hit = any_hit | (f > 0)
    return counted.where(any_hit).select(*key, score.alias("score"))


def _having(tokens: str, term: str) -> Column:
    return F.filter(tokens, lambda x: x == F.lit(term))


def ranked(hits: DataFrame, order: list[Column], name: str, k: int) -> DataFrame:
    """The first k rows with their rank from 1; at most k rows are sorted in one place."""
    top = hits.orderBy(*order).limit(k)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)))


def rrf(left: DataFrame, right: DataFrame, key: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (key, rank_a) and (key, rank_b) (HYB-6)."""
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return left.join(right, key, "full").select(*key, "rank_a", "rank_b", (part("rank_a") + part("rank_b")).alias("score"))


def weighted(left: DataFrame, right: DataFrame, key: list[str], alpha: float) -> DataFrame:
    """alpha times the left score plus the rest times the right one, each scaled to 0..1 over its own hits (HYB-7)."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        lo, hi = df.agg(F.min("score"), F.max("score")).first()
        span = (hi - lo) if hi is not None and hi > lo else None
        value = (F.col("score") - F.lit(lo)) / F.lit(span) if span else F.lit(1.0)
        return df.select(*key, value.alias(name))

    both = scaled(left, "a").join(scaled(right, "b"), key, "full")
    return both.select(*key, (F.lit(alpha) * F.coalesce("a", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))


def concat_fusion(semantic: DataFrame, keyword: DataFrame, path: str, order: list[str], k: int) -> DataFrame:
    """Semantic hits, then keyword hits of other paths, cut to k (HYB-3..HYB-5, JOIN-11)."""
    rest = keyword.join(semantic.select(path).distinct(), path, "left_anti")
    both = semantic.withColumn("source_rank", F.lit(0)).unionByName(rest.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("source_rank", *order).limit(k)
