"""The engine: build an index, search it, read documents, report status (API-1..API-4, API-7..API-9, SNK-*, SRC-14, SRC-15)."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import facets, ivf, postings, rank
from ..sources import files
from ..sources import thesaurus as thes
from ..streaming import ingest
from . import match


@dataclass(frozen=True)
class SearchQuery:
    query: str
    mode: Literal["semantic", "keyword", "hybrid"] = "hybrid"
    top_k: int = 10
    tags: list[str] | None = None
    collections: list[str] | None = None
    year_min: int | None = None
    year_max: int | None = None
    sources: list[str] | None = None
    file_types: list[str] | None = None
    fusion: Literal["rrf", "concat", "weighted"] = "rrf"
    alpha: float = 0.5
    lenient: bool = True
    #: The least similarity of a semantic hit (1 - squared distance / 2) and the least BM25 score of a keyword hit; in hybrid
    #: search, what a ranking does not count with less. None: any.
    min_similarity: float | None = None
    min_bm25: float | None = None
    #: Whether ``word~`` and ``word~2`` stand for words within one or two edits.
    fuzzy: bool = False

    def __post_init__(self):
        if self.mode not in ("semantic", "keyword", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.top_k < 1:
            raise ValueError("top_k must be positive")


#: Chunks for each bucket of terms, and buckets at most; rows of one search that are fetched by their numbers.
BUCKET_CHUNKS, MAX_BUCKETS, FETCHED = 20_000, 4_096, 10_000
#: The form of the tables that this code writes and reads, and how they are compressed.
FORMAT, PACKED = 2, {"compression": postings.COMPRESSION}
#: What names a chunk: its document, its number there, and its place in the index.
_PLACE = ["doc_id", "chunk_id", "seg", "row"]


@dataclass
class Engine:
    """An index under one folder, kept as segments and generations (SNK-*, INC-2, SP-5, SP-13).

    A segment has the documents, chunks, posting lists, terms and vectors of the documents that one
    commit added or changed, and the ids it took out of earlier segments; a commit writes nothing
    else, so it grows with the change. A generation is one small file that names the live segments,
    written last under a number that must be free: until then the index is what it was, and two
    writers cannot both win. Readers may stay at a generation (``at``); :meth:`vacuum` deletes what
    only old ones use, :meth:`compact` makes one segment of many.
    """

    spark: SparkSession
    folder: str
    thesaurus: dict[str, list[str]] = field(default_factory=dict)
    embedder: object = None
    model: str = "md5-hash-384"
    at: int | None = None
    #: How vectors are searched: all of them, or by inverted lists of product-quantised codes (see :mod:`..operators.ivf`).
    index: Literal["exact", "ivf_pq"] = "exact"

    @property
    def _embed(self):
        return self.embedder or rank.hash_embedder()

    _WANTED = {"source": "string", "path": "string", "title": "string", "year": "int", "tags": "array<string>", "collections": "array<string>"}

    def _whole(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text", *[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in self._WANTED.items()])

    def _settings(self, size: int, overlap: int, vectors: bool) -> dict:
        return {"chunk_size": size, "overlap": overlap, "model": self.model if vectors else None, "index": self.index if vectors else "exact"}

    @staticmethod
    def sources_digest(docs: DataFrame) -> str:
        """One digest of all documents: their ids, texts and metadata."""
        row = F.to_json(F.struct(*[c for c in docs.columns if c != "doc_id"]))
        got = ingest.digest(docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha1(row)).alias("key"))).first()
        return (got["digest"] if got else None) or "empty"

    @staticmethod
    def _schema(table: str, id_type: str) -> str:
        """The columns of a segment's table, so that no reader has to look them up in its files."""
        place = f"doc_id {id_type}, chunk_id int, seg int, row long"
        return {
            "documents": f"doc_id {id_type}, text string, {', '.join(f'{c} {t}' for c, t in Engine._WANTED.items())}, seg int",
            "chunks": f"doc_id {id_type}, chunk_id int, start int, chunk_text string, seg int, row long, n_tokens int",
            "postings": f"{postings.schema_of(id_type)}, bucket int",
            "terms": "term string, df long, cf long",
            "spellings": "variant string, term string, bucket int",
            "vectors": f"{place}, embedding array<float>",
            "codes": f"{place}, codes binary, list int",
            "gone": f"doc_id {id_type}, at int",
            "files": f"doc_id {id_type}, path string, modified timestamp, length long, seg int",
        }[table]

    # Files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._path(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def generations(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("generations") if n.endswith(".json")]

    def _manifest(self) -> dict | None:
        """The generation that this engine reads."""
        number = self.at if self.at is not None else max(self.generations(), default=None)
        fs, path = self._path(f"generations/{number or 0:012d}.json")
        if number is None or not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self) -> dict:
        found = self._manifest()
        if found is None:
            raise FileNotFoundError(f"no complete index in {self.folder}")
        if found.get("format") != FORMAT:
            raise ValueError(f"the index in {self.folder} has tables of another form: build it anew")
        return found

    def _finish(self, manifest: dict) -> None:
        """The generation's file, written beside and put in its place last; where another writer was first, an error."""
        number = max(self.generations(), default=-1) + 1
        if number != manifest["generation"]:
            raise RuntimeError("the index has been changed by another writer")
        fs, path = self._path(f"generations/{number:012d}.json")
        _, beside = self._path(f"generations/.{uuid.uuid4().hex}")
        out = fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(beside, path):
            raise RuntimeError("the index has been changed by another writer")

    # Writing

    def _write_segment(self, docs: DataFrame | None, gone: DataFrame | None, number: int, settings: dict, id_type: str, buckets: int | None, fitted: str | None = None, seen: DataFrame | None = None) -> dict:
        """The tables of a segment; what a manifest says of it. ``seen``: the files that were read for it."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/segments/{name}"
        made = {"name": name, "number": number, "documents": docs is not None, "gone": gone is not None, "n_chunks": 0, "n_tokens": 0, "buckets": buckets, "fitted": fitted, "files": seen is not None, "spellings": docs is not None}
        if seen is not None:
            seen.select("doc_id", "path", "modified", "length").withColumn("seg", F.lit(number)).write.options(**PACKED).parquet(f"{at}/files")
        if gone is not None:
            gone.select(F.col("doc_id").cast(id_type).alias("doc_id")).distinct().withColumn("at", F.lit(number)).write.options(**PACKED).parquet(f"{at}/gone")
        if docs is None:
            return made
        docs.withColumn("seg", F.lit(number)).write.options(**PACKED).parquet(f"{at}/documents")
        chunks = C.chunk(self.spark.read.parquet(f"{at}/documents").select("doc_id", "text"), size=settings["chunk_size"], overlap=settings["overlap"])
        numbered = chunks.withColumn("seg", F.lit(number)).withColumn("row", F.monotonically_increasing_id()).withColumn("n_tokens", F.size(T.tokens(F.col("chunk_text"))))
        numbered.write.options(**PACKED).parquet(f"{at}/chunks")
        written = self.spark.read.parquet(f"{at}/chunks")
        n, tokens = written.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        made |= {"n_chunks": n, "n_tokens": tokens, "buckets": buckets or min(MAX_BUCKETS, max(8, n // BUCKET_CHUNKS))}
        postings.write(written.withColumn("tokens", T.tokens(F.col("chunk_text"))), at, made["buckets"])
        if settings["model"] is not None:
            rank.embed(written, self._embed, "chunk_text").select("seg", "row", "doc_id", "chunk_id", "embedding").write.options(**PACKED).parquet(f"{at}/vectors")
        if settings["index"] == "ivf_pq":
            vectors = self.spark.read.parquet(f"{at}/vectors")
            if fitted is None and n:
                ivf.fit(vectors, ["seg", "row"]).write(self.spark, f"{at}/fitted")
                made["fitted"] = name
            if made["fitted"]:
                codes = ivf.encode(vectors, ivf.Model.read(self.spark, f"{self.folder}/segments/{made['fitted']}/fitted"), _PLACE)
                codes.hint("rebalance", "list").write.partitionBy("list").parquet(f"{at}/codes")
        return made

    def _commit(self, before: dict | None, docs: DataFrame | None, gone: DataFrame | None, settings: dict, digest: str | None = None, seen: DataFrame | None = None, followed: dict | None = None) -> None:
        """One more generation: the segments of ``before``, if any, and a new one. ``followed``: the last batch of each stream."""
        segments = before["segments"] if before else []
        lost = (0, 0)
        if gone is not None:
            lost = self.chunks().join(gone, "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        id_type = before["id_type"] if before else docs.schema["doc_id"].dataType.simpleString()
        docs = docs if docs is None else docs.withColumn("doc_id", F.col("doc_id").cast(id_type))
        new = self._write_segment(docs, gone, max((s["number"] for s in segments), default=-1) + 1, settings, id_type, segments[0]["buckets"] if segments else None, segments[-1]["fitted"] if segments else None, seen)
        manifest = {
            "followed": (before or {}).get("followed", {}) | (followed or {}),
            "generation": max(self.generations(), default=-1) + 1 if before is None else before["generation"] + 1,
            "settings": settings,
            "id_type": id_type,
            "format": FORMAT,
            "segments": [*segments, new],
            "n_chunks": (before["n_chunks"] if before else 0) - lost[0] + new["n_chunks"],
            "n_tokens": (before["n_tokens"] if before else 0) - lost[1] + new["n_tokens"],
        }
        manifest["digest"] = digest or self.sources_digest(self._read(manifest, "documents").drop("seg"))
        manifest["built"] = self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
        self._finish(manifest)

    def build(self, docs: DataFrame, size: int = 300, overlap: int = 50, vectors: bool = True, digest: str | None = None) -> None:
        """Write everything anew, as one segment. ``docs``: doc_id, text and any of source, path, title, year, tags, collections."""
        self._commit(None, self._whole(docs), None, self._settings(size, overlap, vectors), digest)

    def ensure(self, docs: DataFrame, size: int = 300, overlap: int = 50, vectors: bool = True) -> str:
        """Bring the index up to date with ``docs`` by the least work (INC-1, INC-2): ``reused``, ``updated`` or ``built``."""
        then, settings = self._manifest(), self._settings(size, overlap, vectors)
        digest = self.sources_digest(self._whole(docs))
        if then is not None and then.get("format") == FORMAT and then["settings"] == settings:
            if ingest.unchanged(then["digest"], digest, settings, settings):
                return "reused"
            self.update(docs, digest=digest)
            return "updated"
        self.build(docs, size, overlap, vectors, digest)
        return "built"

    def update(self, docs: DataFrame, complete: bool = True, digest: str | None = None) -> None:
        """Index added and changed documents only; those that ``docs`` no longer has go (INC-2), or stay if it isn't ``complete`` (SP-13: add)."""
        before = self._now()
        whole, old = self._whole(docs), self.documents()
        state = lambda df: df.select("doc_id", F.sha1(F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"]))).alias("sha1"))
        change = ingest.diff(state(old), state(whole), "doc_id")
        stale = change.where(F.col("change").isin("changed", "removed") if complete else F.col("change") == "changed").select("doc_id")
        fresh = change.where("change IN ('added', 'changed')").select("doc_id")
        self._commit(before, whole.join(fresh, "doc_id", "left_semi"), stale, before["settings"], digest)

    def add(self, docs: DataFrame) -> None:
        """Add documents, or put them in the place of those with their ids (SP-13)."""
        self.update(docs, complete=False)

    def remove(self, doc_ids: DataFrame) -> None:
        """Take documents out of the index (SP-13): their ids are all that is written."""
        before = self._now()
        self._commit(before, None, doc_ids.select("doc_id"), before["settings"])

    # Watching

    def watch(self, folder: str, file_types: list[str], size: int = 300, overlap: int = 50, vectors: bool = True) -> dict[str, int]:
        """One look at a folder of files (INC-3): how many were added, changed and removed since the last one.

        The index knows each file it has read by time and length, so a look lists the folder and reads only files that are
        new or differ; files that are gone, and former texts, leave the index in the same commit. Files without text are
        known too, and not read again. Without an index, one is built; an index that had the folder's documents without
        having watched it reads them once more. A look without a change commits nothing. A file that changes between the
        listing and the reading is read again at the next look; one that vanishes there is an error, and the index stays.
        """
        fs, at = self._path("looks/" + uuid.uuid4().hex)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        under = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
        listed = files.scan(self.spark, folder, file_types).select(files.doc_id(F.col("path")).alias("doc_id"), "path", "modified", "length")
        state = F.concat_ws(":", F.unix_micros("modified").cast("string"), F.col("length").cast("string"))
        before = self._manifest()
        known = self.spark.createDataFrame([], "doc_id string, state string")
        if before is not None:
            known = self.documents().where((F.col("source") == "file") & F.startswith("path", F.lit(under))).select("doc_id", F.lit("").alias("state"))
            if self._raw(before, "files") is not None:
                known = known.union(self._read(before, "files").where(F.startswith("path", F.lit(under))).select("doc_id", state.alias("state")))
            known = known.groupBy("doc_id").agg(F.max("state").alias("state"))
        change = ingest.diff(known, listed.withColumn("state", state), "doc_id", "state").where("change <> 'same'")
        change.join(listed, "doc_id", "left").write.parquet(at.toString())
        try:
            found = self.spark.read.parquet(at.toString())
            counts = {"added": 0, "changed": 0, "removed": 0} | {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
            fresh = found.where("change <> 'removed' AND path IS NOT NULL")
            n = counts["added"] + counts["changed"]
            if not n and not counts["removed"] and before is not None:
                return counts
            if n <= FETCHED:
                paths = [r["path"] for r in fresh.select("path").collect()]
                read = files.read(self.spark, paths) if paths else files.scan(self.spark, folder, []).limit(0)
            else:  # much has changed: all is listed again and what has changed is kept
                read = files.scan(self.spark, folder, file_types).join(fresh.select("path"), "path", "left_semi")
            docs = self._whole(files.documents_of(read))
            settings = before["settings"] if before else self._settings(size, overlap, vectors)
            self._commit(before, docs, found.select("doc_id") if before else None, settings, f"watched {uuid.uuid4().hex}", fresh)
            return counts
        finally:
            fs.delete(at, True)

    def follow(self, stream: DataFrame, checkpoint: str, order: str | None = None, deleted: str | None = None, size: int = 300, overlap: int = 50, vectors: bool = True):
        """Keep the index up with a stream of documents, over what is there (INC-3): a started query that stops at the end.

        Each batch is one commit: its documents are put in the place of those with their ids, and rows where the boolean
        column ``deleted`` is true take theirs out. Of several rows of a document in a batch, the one with the largest
        ``order`` counts, of equals the one with the largest digest. The generation's file names the last batch of each
        stream, so a batch that comes again after a crash changes nothing.
        """
        token = self._token(checkpoint)

        def take(batch: DataFrame, number: int) -> None:
            engine = replace(self, spark=batch.sparkSession)
            before = engine._manifest()
            if before is not None and before.get("followed", {}).get(token, -1) >= number:
                return
            row = F.struct(*batch.columns)
            rank_of = F.struct(*([F.col(order)] if order else []), F.sha1(F.to_json(row)))
            # Only rows of documents that repeat are brought together: the texts of the others stay where they are.
            ids = batch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
            last = batch
            if not ids.isEmpty():
                again = F.col("doc_id").eqNullSafe(F.col("_again"))
                last = batch.join(ids, again, "left_semi").groupBy("doc_id").agg(F.max_by(row, rank_of).alias("row")).select("row.*").unionByName(batch.join(ids, again, "left_anti"))
            kept = last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last
            settings = before["settings"] if before else engine._settings(size, overlap, vectors)
            engine._commit(before, engine._whole(kept), last.select("doc_id") if before else None, settings, f"followed {uuid.uuid4().hex}", followed={token: number})

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _token(self, checkpoint: str) -> str:
        """The name of a stream, kept beside its checkpoint: a new checkpoint counts its batches anew."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/index_stream")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, False)
            out.write(bytearray(uuid.uuid4().hex.encode()))
            out.close()
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def flush(self) -> None:
        """Drop all documents; the index stays, empty (SP-13)."""
        self.remove(self.documents().select("doc_id"))

    def compact(self) -> None:
        """One segment in the place of many, without what was taken out."""
        before = self._now()
        alone = before | {"segments": []}
        seen = self._read(before, "files") if self._raw(before, "files") is not None else None
        new = self._write_segment(self.documents(), None, max(s["number"] for s in before["segments"]) + 1, before["settings"], before["id_type"], None, seen=seen)
        self._finish(alone | {"generation": before["generation"] + 1, "segments": [new], "n_chunks": new["n_chunks"], "n_tokens": new["n_tokens"]})

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` generations, and the segments that none of those names (unfinished ones too, so not while writing); how many segments went."""
        numbers = self.generations()
        used: set[str] = set()
        for n in numbers[-keep:]:
            used |= {s[k] for s in replace(self, at=n)._now()["segments"] for k in ("name", "fitted")}
        for n in numbers[:-keep]:
            fs, path = self._path(f"generations/{n:012d}.json")
            fs.delete(path, False)
        gone = [s for s in self._names("segments") if s not in used]
        for s in gone:
            fs, path = self._path(f"segments/{s}")
            fs.delete(path, True)
        fs, path = self._path("looks")
        fs.delete(path, True)
        return len(gone)

    # Reading

    def _gone(self, manifest: dict) -> DataFrame | None:
        rows = self._raw(manifest, "gone")
        return None if rows is None else rows.groupBy("doc_id").agg(F.max("at").alias("at"))

    def _raw(self, manifest: dict, table: str) -> DataFrame | None:
        """All rows of a table of the live segments; None where no segment has it."""
        has = {"gone": lambda s: s["gone"], "files": lambda s: s.get("files", False), "spellings": lambda s: s.get("spellings", False), "codes": lambda s: s["documents"] and s["fitted"]}.get(table, lambda s: s["documents"])
        parts = [f"{self.folder}/segments/{s['name']}/{table}" for s in manifest["segments"] if has(s)]
        reader = self.spark.read.schema(self._schema(table, manifest["id_type"]))
        if table in ("postings", "codes", "spellings"):  # partitioned: each segment is a root of its own
            return reduce(DataFrame.unionByName, [reader.parquet(p) for p in parts]) if parts else None
        return reader.parquet(*parts) if parts else None

    def _read(self, manifest: dict, table: str) -> DataFrame:
        """The live rows of a table."""
        rows, gone = self._raw(manifest, table), self._gone(manifest)
        if rows is None:
            raise FileNotFoundError(f"no {table} in {self.folder}")
        if gone is None:
            return rows
        g = gone.select(F.col("doc_id").alias("_gone"), "at")
        return rows.join(g, (rows["doc_id"] == g["_gone"]) & (rows["seg"] < g["at"]), "left_anti")

    def _index(self, manifest: dict) -> postings.Index:
        n = manifest["n_chunks"]
        near = self._raw(manifest, "spellings") if all(s.get("spellings") for s in manifest["segments"] if s["documents"]) else None
        return postings.Index(self.spark, self._raw(manifest, "postings"), self._raw(manifest, "terms"), manifest["segments"][0]["buckets"], n, manifest["n_tokens"] / n if n else 0.0, self._gone(manifest), near)

    def _fitted(self, manifest: dict) -> ivf.Model:
        return ivf.Model.read(self.spark, f"{self.folder}/segments/{manifest['segments'][-1]['fitted']}/fitted")

    def documents(self) -> DataFrame:
        return self._read(self._now(), "documents").drop("seg")

    def chunks(self) -> DataFrame:
        return self._read(self._now(), "chunks")

    def vectors(self) -> DataFrame:
        return self._read(self._now(), "vectors")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **kind) -> Engine:
        """An index that is complete: without a generation, or built by another model, it is an error (SRC-15, Q-15)."""
        engine = cls(spark, folder, **kind)
        status = engine.status()
        engine = replace(engine, index=status["index"])
        if status["model"] not in (None, engine.model):
            raise ValueError(f"the index was built with {status['model']}, not {engine.model}")
        return engine

    def snapshot(self) -> Engine:
        """This engine at the present generation, whatever is written later."""
        return replace(self, at=self._now()["generation"])

    def status(self) -> dict:
        """What the manifest says, and the bytes that the live segments take."""
        now = self._now()
        sizes = []
        for s in now["segments"]:
            fs, path = self._path(f"segments/{s['name']}")
            sizes.append(fs.getContentSummary(path).getLength())
        return {"status": "ok", "index_type": now["settings"]["index"], "generation": now["generation"], "segments": len(sizes), "total_chunks": now["n_chunks"], "built": now["built"], "digest": now["digest"], "bytes": sum(sizes), **now["settings"]}

    def _barred(self, q: SearchQuery) -> DataFrame | None:
        """doc_id of the documents that the facets keep out; None: no facet. What the documents don't know passes (FIL-5)."""
        if not (q.tags or q.collections or q.sources or q.file_types or q.year_min is not None or q.year_max is not None):
            return None
        ok: Column = facets.any_of("tags", q.tags) & facets.any_of("collections", q.collections) & facets.year_between(F.col("year"), q.year_min, q.year_max)
        ok = ok & facets.file_types("path", q.file_types)
        if q.sources:
            ok = ok & F.col("source").isin(q.sources)
        return self.documents().where(~F.coalesce(ok, F.lit(False))).select("doc_id")

    def advanced(self, query: str, limit: int = 50) -> DataFrame:
        """The advanced keyword search: the strict match language, marked snippets, 50 rows (FTS-16)."""
        return self.search(SearchQuery(query, mode="keyword", top_k=limit, lenient=False))

    def grouped(self, q: SearchQuery, by: Literal["path", "basename"] = "path") -> DataFrame:
        """The hits of a search by path or file name, in order of their first hit (AGG-1, AGG-2)."""
        hits = self.search(q)
        hits = hits.withColumn("ord", F.row_number().over(W.orderBy(F.desc("score"), "doc_id", "chunk_id")))  # top_k rows
        return facets.group_by_basename(hits) if by == "basename" else facets.group_hits(hits)

    def search(self, q: SearchQuery) -> DataFrame:
        """path, snippet, score, distance, similarity of at most top_k hits, best first; facets filter before the cut (Q-1, Q-4).

        Keyword hits come from the posting lists of the query's terms, and only the chunks shown are read; scores use the
        statistics of the whole index, also under facets. ``rrf`` fuses the best max(5 * top_k, 50) of both rankings,
        ``concat`` as many semantic hits with all keyword hits, ``weighted`` every chunk's similarity with every keyword score.
        Thresholds hold before the fusion: hits below them are in neither ranking.
        """
        now = self._now()
        barred = self._barred(q)
        text = thes.expand_query(q.query, self.thesaurus) if thes.matched_concepts(q.query, self.thesaurus) else q.query
        key = ["doc_id", "chunk_id"]
        both = _PLACE
        deep = max(q.top_k, 10) * 5
        text = self.expand_fuzzy(text) if q.fuzzy and q.mode != "semantic" else text
        node = match.parse(text, lenient=q.lenient and not q.fuzzy) if q.mode != "semantic" else None
        keyword = semantic = None
        if q.mode != "semantic":
            index = self._index(now)
            cut = {"keyword": q.top_k, "hybrid": deep if q.fusion == "rrf" else None}[q.mode]
            keyword = index.top(node, cut, barred) if cut else index.search(node, barred)
            keyword = keyword if q.min_bm25 is None else keyword.where(F.col("score") >= q.min_bm25)
        if q.mode != "keyword":
            vector = self._embed([" ".join(thes.expand_terms(q.query, self.thesaurus))])[0]
            rows = self._read(now, "vectors")
            rows = rows if barred is None else rows.join(barred, "doc_id", "left_anti")
            k = q.top_k if q.mode == "semantic" else deep
            if q.mode == "hybrid" and q.fusion == "weighted":
                semantic = rank.distances(rows, vector, both)
            elif now["segments"][-1]["fitted"] and all(s["fitted"] for s in now["segments"] if s["n_chunks"]):
                codes = self._read(now, "codes")
                codes = codes if barred is None else codes.join(barred, "doc_id", "left_anti")
                fitted = self._fitted(now)  # under facets the nearest rows may lie in any list
                semantic = ivf.knn(codes, rows, fitted, vector, k, both, probes=None if barred is None else len(fitted.centres))
            else:
                semantic = rank.knn(rows, vector, k, both)
            semantic = semantic.withColumn("similarity", 1 - F.col("distance") / 2).withColumn("score", F.col("similarity"))
            semantic = semantic if q.min_similarity is None else semantic.where(F.col("similarity") >= q.min_similarity)
        if q.mode == "keyword":
            top = keyword.orderBy(F.desc("score"), *key).limit(q.top_k)
        elif q.mode == "semantic":
            top = semantic.orderBy("distance", *key).limit(q.top_k)
        elif q.fusion == "rrf":
            a = rank.ranked(semantic, [F.col("distance"), *map(F.col, key)], "rank_a", deep).select(*both, "rank_a")
            b = rank.ranked(keyword, [F.desc("score"), *map(F.col, key)], "rank_b", deep).select(*both, "rank_b")
            top = rank.rrf(a, b, both).orderBy(F.desc("score"), *key).limit(q.top_k)
        elif q.fusion == "weighted":
            top = rank.weighted(semantic.select(*both, "score"), keyword, both, q.alpha).orderBy(F.desc("score"), *key).limit(q.top_k)
        else:
            top = rank.concat_fusion(semantic.select(*both, "score"), keyword, "doc_id", [F.desc("score"), *map(F.col, key)], q.top_k)
        return self._shown(now, top, node, q.top_k)

    def _shown(self, now: dict, top: DataFrame, node, k: int) -> DataFrame:
        """The hits with path, title and snippet: up to FETCHED of them by number, so that nothing else of the tables is read."""
        key = ["doc_id", "chunk_id"]
        chunks, docs = self._raw(now, "chunks"), self._read(now, "documents")
        if k <= FETCHED:
            rows = top.toArrow()
            top = self.spark.createDataFrame(rows, top.schema)
            chunks = chunks.where(F.col("row").isin(rows["row"].to_pylist()) & F.col("seg").isin(sorted(set(rows["seg"].to_pylist()))))
            docs = docs.where(F.col("doc_id").isin(sorted(set(rows["doc_id"].drop_null().to_pylist()))))
        shown = top.join(F.broadcast(chunks.select("seg", "row", "chunk_text")) if k <= FETCHED else chunks.select("seg", "row", "chunk_text"), ["seg", "row"])
        named = shown.join(F.broadcast(docs.select("doc_id", "path", "title")) if k <= FETCHED else docs.select("doc_id", "path", "title"), "doc_id", "left")
        snippet = match.snippet(F.col("chunk_text"), node) if node is not None else T.shorten(F.col("chunk_text"))
        extra = [c for c in ("distance", "similarity") if c in top.columns]
        out = named.select(F.coalesce("path", F.col("doc_id").cast("string")).alias("path"), "doc_id", "chunk_id", "title", snippet.alias("snippet"), "score", *extra)
        return out.orderBy(F.desc("score"), *key).limit(k)

    def fuzzy_terms(self, word: str, distance: int = 1) -> DataFrame:
        """term, df (chunks that hold it), distance of the index's terms within so many edits of a word (FTS-17)."""
        index, folded = self._index(self._now()), T.fold_py(word)
        df = index.frequencies(index.near_terms(folded, distance))
        rows = self.spark.createDataFrame([(t, n) for t, n in df.items() if n], "term string, df long")
        return rows.withColumn("distance", F.levenshtein("term", F.lit(folded)).cast("int")).orderBy("distance", F.desc("df"), "term")

    def expand_fuzzy(self, query: str) -> str:
        """The query with each ``word~`` or ``word~2`` as any of the index's terms within one or two edits of the word; one
        that is near to none stays as a word. Signs in quotes are text."""
        import regex

        index = self._index(self._now())

        def any_of(m) -> str:
            if m["quoted"]:
                return m[0]
            terms = index.near_terms(T.fold_py(m["word"]), int(m["n"] or 1)) or [m["word"]]
            return "(" + " OR ".join(f'"{t}"' for t in terms) + ")"

        return regex.sub(r'(?<quoted>"[^"]*")|(?<word>[\p{L}\p{N}\p{M}]+)~(?<n>[12])?', any_of, query)

    def document(self, doc_id) -> dict | None:
        row = self.documents().where(F.col("doc_id") == F.lit(doc_id)).first()
        return row.asDict(recursive=True) if row else None

    def summarise(self, doc_id, query: str | None = None) -> str:
        found = self.document(doc_id)
        if found is None:
            raise KeyError(doc_id)
        return facets.summarise(found["text"], query)

    def summarise_hits(self, q: SearchQuery) -> str:
        """One summary of the documents that a search finds, driven by its query (SP-11)."""
        hits = self.search(q).select("doc_id").distinct()
        return facets.summarise_many(self.documents().join(hits, "doc_id", "left_semi").orderBy("doc_id"), q.query)

    def save_search(self, name: str, q: SearchQuery, parent: str | None = None) -> None:
        """Keep a search under a name, and under another one if given (SP-15); the last one of a name counts."""
        if parent is not None and parent not in {r["name"] for r in self.saved_searches().collect()}:
            raise KeyError(parent)
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(parent).cast("string").alias("parent"), F.lit(json.dumps(asdict(q))).alias("query"), F.current_timestamp().cast("string").alias("saved"))
        row.write.mode("append").json(f"{self.folder}/searches")

    def saved_searches(self) -> DataFrame:
        """name, parent, path (names from the top, joined by slashes) and query of the saved searches."""
        fs, path = self._path("searches")
        schema = "name string, parent string, query string, saved string"
        rows = self.spark.read.schema(schema).json(f"{self.folder}/searches") if fs.exists(path) else self.spark.createDataFrame([], schema)
        last = rows.groupBy("name").agg(F.max_by("parent", "saved").alias("parent"), F.max_by("query", "saved").alias("query"))
        up = {r["name"]: r["parent"] for r in last.select("name", "parent").collect()}  # as many as someone has saved

        def path_of(name: str) -> str:
            names: list[str] = []
            while name is not None and name not in names:
                names.append(name)
                name = up.get(name)
            return "/".join(reversed(names))

        paths = self.spark.createDataFrame([(n, path_of(n)) for n in up], "name string, path string")
        return last.join(paths, "name").select("name", "parent", "path", "query").orderBy("path")

    def search_saved(self, name: str) -> DataFrame:
        row = self.saved_searches().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return self.search(SearchQuery(**json.loads(row["query"])))

    def options(self) -> DataFrame:
        return facets.filter_options(self.documents())

    def config(self) -> dict:
        return {k: v for k, v in asdict(SearchQuery("")).items() if k != "query"}
