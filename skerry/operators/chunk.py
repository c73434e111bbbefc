"""Chunking (TR-1..TR-4, SP-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _check(size: int, overlap: int) -> int:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunks need size > 0 and 0 <= overlap < size")
    return size - overlap


def windows(length: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows over ``length`` units: every step below the length, so a tail inside the last one counts."""
    step = _check(size, overlap)
    last = F.greatest(F.lit(0), F.ceil(length / F.lit(step)).cast("int") - 1)
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step))


def pieces(text: Column, size: int, overlap: int) -> Column:
    """The windows' texts. The text is cut once into blocks of a step each, and a window is its block with the head of the next ones: linear in its length."""
    step = _check(size, overlap)
    more = -(-size // step)

    def windows_of(blocks: Column) -> Column:
        return F.transform(blocks, lambda _, k: F.substring(F.array_join(F.slice(blocks, k + 1, F.lit(more)), ""), 1, size))

    return T.let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), windows_of)


def chunk(docs: DataFrame, text: str = "text", size: int = 300, overlap: int = 50) -> DataFrame:
    """One row a chunk: the columns of ``docs`` but the text, then chunk_id, start, chunk_text. Blank chunks go; ids stay."""
    keep = [c for c in docs.columns if c != text]
    cut = docs.select(*keep, F.posexplode(pieces(F.col(text), size, overlap)).alias("chunk_id", "_piece"))
    return cut.select(*keep, "chunk_id", (F.col("chunk_id") * (size - overlap)).alias("start"), T.strip(F.col("_piece")).alias("chunk_text")).where("chunk_text <> ''")


def chunk_tokens(docs: DataFrame, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """Windows of tokens rather than characters (SP-8)."""
    keep = [c for c in docs.columns if c != text]
    tk = docs.select(*keep, T.tokens(F.col(text)).alias("_tk"))
    cut = tk.select(*keep, "_tk", F.posexplode(windows(F.size("_tk"), size, overlap)).alias("chunk_id", "start"))
    return cut.select(*keep, "chunk_id", "start", F.slice("_tk", F.col("start") + 1, size).alias("tokens"))


def preview(chunks: DataFrame, key: str = "doc_id", docs: int = 3, each: int = 2, width: int = 300) -> DataFrame:
    """The first chunks of the first documents, shortened (TR-3, WIN-3)."""
    first = chunks.select(key).distinct().orderBy(key).limit(docs)
    ranked = chunks.join(F.broadcast(first), key, "left_semi").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("chunk_id")))
    return ranked.where(F.col("_r") <= each).select(key, "chunk_id", T.shorten(F.col("chunk_text"), width).alias("preview"))
