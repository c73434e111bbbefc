"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word is a maximal run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OPEN: list[list[DataFrame]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut, and losing executors loses nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/skerry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in a total order: sorted in ranges, then numbered by the ranges' counts (a row for each range)."""
    rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    place = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = place.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    return place.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias("rank"))


def released(run):
    """A function of Arrow batches that gives freed memory back after each one; a worker's pool would keep it for its next task."""

    def each(batches):
        import pyarrow as pa

        pool = pa.default_memory_pool()
        for out in run(batches):
            yield out
            pool.release_unused()
        pool.release_unused()

    return each


@contextmanager
def scratch():
    """What is materialised within is deleted at the end, but for the frames given to the function that this yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _OPEN.pop()
        for df in made:
            if any(df is k for k in kept):
                if _OPEN:
                    _OPEN[-1].append(df)
            else:
                drop_materialized(df)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`materialize`."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.getName().startswith("skerry-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
