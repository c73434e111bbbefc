"""Manifests, change detection and streaming ingestion (INC-1..INC-3, AGG-8, HASH-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """md5 over the sorted ``key`` strings, for the whole table or by group (AGG-8).

    Keys are hashed in place and gathered by a hash prefix first, so no task holds more than its share; the digest of a
    group is that of its prefixes' digests in order.
    """
    by = by or []
    part = F.substring(F.md5(F.col("key").cast("binary")), 1, 3)
    first = entries.groupBy(*by, part.alias("_p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("key")), "|").cast("binary")).alias("_d"))
    return first.groupBy(*by).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "").cast("binary")).alias("digest"))


def manifest(files: DataFrame) -> DataFrame:
    """path, modified, sha1 of files with their content."""
    return files.select("path", "modified", F.sha1("content").alias("sha1"))


def diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "sha1") -> DataFrame:
    """key, change (added, changed, removed, same) of two manifests (INC-2)."""
    a = old.select(key, F.col(value).alias("_old"))
    b = new.select(key, F.col(value).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))


def unchanged(old_digest: str | None, new_digest: str, settings_then: dict | None, settings_now: dict) -> bool:
    """Whether an index can be used as it is: sources and settings are the same (INC-1, Q-14)."""
    return old_digest is not None and old_digest == new_digest and settings_then == settings_now


def watch_documents(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, size: int = 300, overlap: int = 50, key: str = "doc_id"):
    """Ingest new Parquet files of a folder into chunks at ``out``, each file once; a content seen before isn't chunked again (INC-3).

    Runs over what is there and stops; a scheduler starts it again. The checkpoint remembers the files and the contents.
    """
    from ..operators.chunk import chunk

    stream = spark.readStream.schema(schema).parquet(folder)
    fresh = stream.withColumn("sha1", F.sha1("text")).dropDuplicates(["sha1"])

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch.select(key, "sha1", "text"), size=size, overlap=overlap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
