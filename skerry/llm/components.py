"""Connected components of a link table by repeated contraction.

Each round first connects the links in tasks of LOCAL links each, which leaves stars; links that
one such task holds are done by that. Else it orders the nodes anew (by their bits against a key
of the round), maps every node to the first of itself and its neighbours, contracts the links by
that map, and writes the rest to the shared folder. As the order changes, a path whose numbers
ascend is halved a round at least, not followed link by link. The maps are composed at the end,
once. The map is an aggregation with map-side combine (callers delete the rounds' tables by
:func:`.common.scratch`); the links move by equi-joins, where those of a hub share a key, which
Spark's skew join divides (each round leaves a hub fewer of them).

Defined results: links with a null end are ignored; repeated links and loops count for nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

#: Links that a task connects at a time.
LOCAL = 1 << 17


def _round_key(k: int) -> int:
    """The k-th of a sequence of signed 64-bit keys."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Every node of some links with the least node that they connect it with."""
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        forest.join(x, y)
    roots = np.fromiter(map(forest.find, range(len(nodes))), np.int64, len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], names=["a", "b"])


def _star_batches(most: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > most:
                yield _stars(held)
                held, n = [], 0
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)))
            n += batch.num_rows
        if n:
            yield _stars(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """``links``: (a long, b long). Returns (node, root) for every node with a link to another one; nodes of one component share a root."""
    rest = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while True:
        n = rest.count()
        rest = materialize(rest.coalesce(max(1, -(-n // LOCAL))).mapInArrow(released(_star_batches(LOCAL)), "a long, b long"))
        if n <= LOCAL:
            maps.append(rest.select(F.col("a").alias("node"), F.col("b").alias("root")))
            break
        key = F.lit(_round_key(len(maps)))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(F.col("b").bitwiseXOR(key)), F.col("a").bitwiseXOR(key)).bitwiseXOR(key)
        step = materialize(both.groupBy("a").agg(first.alias("root")).withColumnRenamed("a", "node"))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = rest.where("a <> b").join(left, "a").join(right, "b").where("ra <> rb")
        rest = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    roots = maps[-1]
    for step in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return materialize(roots) if len(maps) > 1 else roots
