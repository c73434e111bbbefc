"""Folders of files as documents (SRC-1, SRC-8), and YAML configuration (SRC-2)."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import extract_text


@dataclass
class Config:
    input_folder: str = "."
    output_folder: str = "index"
    file_types: list[str] = field(default_factory=lambda: [".pdf", ".md", ".epub", ".docx", ".html", ".htm"])
    ontology_file: str | None = None
    chunk_size: int = 300
    overlap: int = 50
    embedding_model: str | None = None
    library_enabled: bool = False
    library_directory: str | None = None
    encoding: str = "utf-8"
    save_raw_text: bool = False
    log_progress: bool = False

    def engine(self) -> dict:
        """What an engine takes from the configuration: the thesaurus, and the embedding model with its function."""
        from ..operators import rank
        from .thesaurus import load

        kind: dict = {"thesaurus": load(self.ontology_file)} if self.ontology_file else {}
        if self.embedding_model:
            kind |= {"model": self.embedding_model, "embedder": rank.embedder(self.embedding_model)}
        return kind


def load_config(path: str) -> Config:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    library = next((v for v in data.values() if isinstance(v, dict) and "data_directory" in v), {})
    known = {k: v for k, v in data.items() if k in Config.__dataclass_fields__ and v is not None}
    return Config(**known, library_enabled=bool(library.get("enabled", False)), library_directory=library.get("data_directory"))


def scan(spark: SparkSession, folder: str, file_types: list[str]) -> DataFrame:
    """path, modified, length, content of the files with one of the suffixes, whatever their case; folders below count."""
    if folder.startswith("~"):
        folder = str(Path(folder).expanduser())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.where(T.suffix(F.col("path")).isin([t.lower() for t in file_types]))
    return kept.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, modified, length, content of the files with these paths, which are names and not patterns."""
    import re

    found = spark.read.format("binaryFile").load([re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths])
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def doc_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.regexp_replace(path, "^file:/*", "/"))


def extract(files: DataFrame, markup: str = "strip") -> DataFrame:
    """path, modified, text, error of each file; files are read where they are scanned."""

    def run(batches):
        for part in batches:
            got = [extract_text(p, bytes(c), markup) for p, c in zip(part["path"], part["content"], strict=True)]
            yield part[["path", "modified"]].assign(text=[t for t, _ in got], error=[e for _, e in got])

    return files.select("path", "modified", "content").mapInPandas(run, "path string, modified timestamp, text string, error string")


def documents(spark: SparkSession, folder: str, file_types: list[str], markup: str = "strip") -> DataFrame:
    """Files with text, as doc_id, source, path, text (FIL-7)."""
    return documents_of(scan(spark, folder, file_types), markup)


def documents_of(files: DataFrame, markup: str = "strip") -> DataFrame:
    got = extract(files, markup).where(~T.is_blank(F.col("text")))
    return got.select(doc_id(F.col("path")).alias("doc_id"), F.lit("file").alias("source"), "path", "text")


def pages(table: DataFrame) -> DataFrame:
    """Documents of a table of fetched web pages (url string, html string), as doc_id, source, path, text (SP-18)."""

    def run(batches):
        for part in batches:
            yield part[["url"]].assign(text=[extract_text("page.html", (h or "").encode("utf-8", "replace"))[0] for h in part["html"]])

    got = table.where("url IS NOT NULL").select("url", "html").mapInPandas(run, "url string, text string").where(~T.is_blank(F.col("text")))
    return got.select(F.concat(F.lit("page:"), "url").alias("doc_id"), F.lit("web").alias("source"), F.col("url").alias("path"), "text")
