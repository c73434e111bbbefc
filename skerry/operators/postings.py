"""An inverted index in Parquet: posting lists by term and block, in buckets of terms (SNK-1, FTS-2..FTS-10, FTS-15).

``chunks`` have a segment number ``seg`` and a number ``row`` within it. A posting row holds the
occurrences of one term in one block of BLOCK neighbouring chunks: parallel arrays of the chunk's place
in the block and the position, and what bounds a score there: for some classes of frequency, the
largest frequency and the shortest length. What is of the chunks and not of a term is kept once: a row without a term, in the
bucket OWN, has the doc_id, chunk_id and length of each chunk of a block. Blocks are made where the chunks lie, so only finished posting rows are shuffled, into
buckets by the term's hash; a common term is one row a block, not one list. A query reads the
buckets of its terms and brings their rows together with the block's own row, block by block.

Ranking stops early: the bounds alone say how much a block can score. The best FIRST blocks (k
at least) are scored first; then only blocks whose bound reaches the k-th score found there, and which hold
every term that must be there, are read at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import match

#: Neighbouring chunks in a block: two to this power, 15 at most.
BLOCK_BITS = 10
#: Blocks scored before the others are bounded.
FIRST = 64
#: Terms of a prefix that are asked for by name; beyond, the posting rows are filtered by the prefix itself.
MAX_EXPANSION = 1_000
K1, B = 1.2, 0.75
#: Classes of frequency whose bounds a block keeps apart: 1, 2, 3 to 4, and more.
CLASSES = 4
#: The bucket of the blocks' own rows, and the compression of what is written.
OWN, COMPRESSION = -1, "zstd"
#: Edits of terms that are found by a part that both words share, and leading characters kept of a part.
DELETIONS, LEADING = 2, 8


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def bucket_py(term: str, buckets: int) -> int:
    import zlib

    return zlib.crc32(term.encode()) % buckets


def schema_of(id_type: str) -> str:
    """The columns of posting rows for documents with ids of a type; files have ``bucket`` besides."""
    return f"term string, seg int, block long, n int, cf int, max_tfs array<int>, min_dls array<int>, at array<short>, pos array<int>, docs array<{id_type}>, chunks array<int>, dls array<int>"


def read(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"{schema_of(id_type)}, bucket int").parquet(f"{folder}/postings")


def posting_rows(chunks: DataFrame) -> DataFrame:
    """Posting rows of (seg, row, doc_id, chunk_id, tokens), and each block's own row, whose term is null.

    A block that lies in two tasks gives two rows of the same term and block, which counts as one list in two parts.
    """
    schema = schema_of(chunks.schema["doc_id"].dataType.simpleString())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table["tokens"].combine_chunks()
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if not len(dl) or not dl.sum():
                continue
            row, seg = table["row"].to_numpy(), table["seg"].to_numpy()
            block, place = row >> BLOCK_BITS, (row & ((1 << BLOCK_BITS) - 1)).astype(np.int16)
            yield of_terms(table, lists, dl, seg, block, place)
            yield of_blocks(table, dl, seg, block, place)

    def of_terms(table, lists, dl, seg, block, place):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = pc.list_flatten(lists)
        at = np.repeat(np.arange(len(dl)), dl)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(dl) - dl, dl)
        coded = flat.dictionary_encode()
        term = coded.indices.to_numpy()
        order = np.lexsort((pos, place[at], block[at], seg[at], term))
        term, at, pos = term[order], at[order], pos[order]
        same = (term[1:] == term[:-1]) & (block[at][1:] == block[at][:-1]) & (seg[at][1:] == seg[at][:-1])
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        new_row = np.concatenate([[True], ~same | (at[1:] != at[:-1])])
        row_starts = np.flatnonzero(new_row)
        tf = np.diff(row_starts, append=len(at))
        first_row = np.searchsorted(row_starts, starts)
        offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
        lists_of = lambda values: pa.ListArray.from_arrays(offsets, values)
        group = np.repeat(np.arange(len(starts)), np.diff(first_row, append=len(row_starts))) * CLASSES + np.minimum(tf - 1, 2 + (tf > 4))
        max_tf, min_dl = np.zeros(len(starts) * CLASSES, np.int32), np.full(len(starts) * CLASSES, np.iinfo(np.int32).max, np.int32)
        np.maximum.at(max_tf, group, tf.astype(np.int32))
        np.minimum.at(min_dl, group, dl[at[row_starts]].astype(np.int32))
        classes_of = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * CLASSES), pa.array(values))
        columns = {
            "term": coded.dictionary.take(pa.array(term[starts])),
            "seg": pa.array(seg[at[starts]].astype(np.int32)),
            "block": pa.array(block[at[starts]]),
            "n": pa.array(np.diff(first_row, append=len(row_starts)).astype(np.int32)),
            "cf": pa.array(np.diff(starts, append=len(at)).astype(np.int32)),
            "max_tfs": classes_of(max_tf),
            "min_dls": classes_of(min_dl),
            "at": lists_of(pa.array(place[at])),
            "pos": lists_of(pa.array(pos.astype(np.int32))),
            "docs": pa.nulls(len(starts), pa.list_(table["doc_id"].type)),
            "chunks": pa.nulls(len(starts), pa.list_(pa.int32())),
            "dls": pa.nulls(len(starts), pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def of_blocks(table, dl, seg, block, place):
        import numpy as np
        import pyarrow as pa

        order = np.lexsort((place, block, seg))
        change = (np.diff(block[order]) != 0) | (np.diff(seg[order]) != 0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists_of = lambda values: pa.ListArray.from_arrays(offsets, values)
        none, take = pa.nulls(len(starts), pa.list_(pa.int32())), pa.array(order)
        columns = {
            "term": pa.nulls(len(starts), table["tokens"].type.value_type),
            "seg": pa.array(seg[order][starts].astype(np.int32)),
            "block": pa.array(block[order][starts]),
            "n": pa.array(np.diff(starts, append=len(order)).astype(np.int32)),
            "cf": pa.array(np.zeros(len(starts), np.int32)),
            "max_tfs": none,
            "min_dls": none,
            "at": lists_of(pa.array(place[order])),
            "pos": none,
            "docs": lists_of(table["doc_id"].combine_chunks().take(take)),
            "chunks": lists_of(table["chunk_id"].combine_chunks().take(take)),
            "dls": lists_of(pa.array(dl[order].astype(np.int32))),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return chunks.select("seg", "row", "doc_id", F.col("chunk_id").cast("int").alias("chunk_id"), "tokens").mapInArrow(run, schema)


def write(chunks: DataFrame, folder: str, buckets: int) -> None:
    """Write ``postings`` (by bucket, sorted by term and block) and ``terms`` (term, df) below ``folder``."""
    spark, packed = chunks.sparkSession, {"compression": COMPRESSION}
    rows = posting_rows(chunks).withColumn("bucket", F.coalesce(bucket_of(F.col("term"), buckets), F.lit(OWN)))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").options(**packed).parquet(f"{folder}/postings")
    written = read(spark, folder, chunks.schema["doc_id"].dataType.simpleString()).where("term IS NOT NULL")
    written.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).orderBy("term").write.options(**packed).parquet(f"{folder}/terms")
    near = spellings(spark.read.schema("term string, df long, cf long").parquet(f"{folder}/terms")).withColumn("bucket", bucket_of(F.col("variant"), buckets))
    near.hint("rebalance", "bucket").sortWithinPartitions("bucket", "variant", "term").write.partitionBy("bucket").options(**packed).parquet(f"{folder}/spellings")


def spellings(terms: DataFrame) -> DataFrame:
    """(variant, term): for each of the DELETIONS + 1 parts that a term is cut into, its length, the part's number and its first
    LEADING characters (FTS-17).

    DELETIONS edits leave one of these parts as it is, at most as many places away: so a word looks its own characters there up
    for each length that is near enough. A term has three rows, however long it is.
    """
    parts, n = DELETIONS + 1, F.char_length("term")
    start = lambda i: F.floor(n * i / parts).cast("int")
    variants = [F.concat_ws(":", n, F.lit(i), F.substring("term", start(i) + 1, F.least(start(i + 1) - start(i), F.lit(LEADING)))) for i in range(parts)]
    return terms.select("term", F.explode(F.array(*variants)).alias("variant")).select("variant", "term")


def variants_py(word: str, distance: int) -> set[str]:
    """The variants by which terms within so many edits of a word, at most DELETIONS, are found."""
    found, parts = set(), DELETIONS + 1
    for n in range(max(0, len(word) - distance), len(word) + distance + 1):
        for i in range(parts):
            start, end = n * i // parts, n * (i + 1) // parts
            for at in range(max(0, start - distance), min(start + distance, len(word) - (end - start)) + 1):
                found.add(f"{n}:{i}:{word[at : at + min(end - start, LEADING)]}")
    return found


@dataclass
class Index:
    """What a search reads: posting rows and terms of the live segments, and the numbers that scores need.

    ``gone``: (doc_id, at) of documents taken out of the segments before ``at``, or None.
    """

    spark: SparkSession
    postings: DataFrame
    terms: DataFrame
    buckets: int
    n: int
    avgdl: float
    gone: DataFrame | None = None
    #: (variant, term, bucket) of all live segments, or None where one has none.
    spellings: DataFrame | None = None

    def near_terms(self, word: str, distance: int) -> list[str]:
        """The terms within so many edits of a folded word: those that share a variant, in the buckets of the variants, or
        beyond DELETIONS edits the whole dictionary; each is verified."""
        rows = self.terms
        if self.spellings is not None and distance <= DELETIONS:
            variants = sorted(variants_py(word, distance))
            rows = self.spellings.where(F.col("bucket").isin(sorted({bucket_py(v, self.buckets) for v in variants})) & F.col("variant").isin(variants))
        near = rows.where(F.levenshtein("term", F.lit(word), distance) >= 0)
        return sorted(r["term"] for r in near.select("term").distinct().collect())

    def _of_terms(self, terms: list[str], prefixes: list[str]) -> DataFrame:
        """The posting rows of terms and of prefixes, by their buckets where all are known."""
        known, wide = set(terms), []
        for p in prefixes:
            found = self.terms.where(F.startswith("term", F.lit(p))).select("term").distinct().limit(MAX_EXPANSION + 1).collect()
            if len(found) > MAX_EXPANSION:
                wide.append(p)
            known |= {r["term"] for r in found}
        wanted = F.col("term").isin(sorted(known)) if known else F.lit(False)
        if wide:
            return self.postings.where(reduce(lambda a, b: a | b, [F.startswith("term", F.lit(p)) for p in wide], wanted))
        return self.postings.where(F.col("bucket").isin(sorted({bucket_py(t, self.buckets) for t in known})) & wanted)

    def live(self, rows: DataFrame, doc: str = "doc_id") -> DataFrame:
        """Rows whose document was not taken out of their segment later."""
        if self.gone is None:
            return rows
        g = self.gone.select(F.col("doc_id").alias("_gone"), "at")
        return rows.join(g, (rows[doc] == g["_gone"]) & (rows["seg"] < g["at"]), "left_anti")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many chunks each term is: as counted when written, or counted among the live ones where documents were taken out."""
        if not terms:
            return {}
        if self.gone is None:
            got = self.terms.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))
        else:
            each = self._by_chunk(self._of_terms(terms, []), self._blocks_of(None), F.collect_set("term").alias("terms"))
            got = self.live(each).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return {r["term"]: r["df"] for r in got.collect()}

    def _idf(self, terms: list[str]) -> dict[str, float]:
        import math

        df = self.frequencies(terms)
        return {t: math.log(1.0 + (self.n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms}

    def _part(self, idf: float, tf: Column, dl: Column) -> Column:
        tf, dl = tf.cast("double"), dl.cast("double")
        return F.lit(idf) * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(self.avgdl or 1.0)))

    def bounds(self, node, idf: dict[str, float]) -> DataFrame:
        """(seg, block, bound): the most that a chunk of each block can score, for blocks with every term that must be there."""
        terms, must = match.terms_of(node), match.needed(node)
        weight = F.lit(0.0)
        for t in terms:
            weight = F.when(F.col("term") == t, F.lit(idf[t])).otherwise(weight)
        most = F.array_max(F.zip_with("max_tfs", "min_dls", lambda tf, dl: self._part(1.0, tf, dl)))
        rows = self._of_terms(*_wanted(node)).groupBy("seg", "block", "term").agg(F.max(most).alias("most"))
        part = weight * F.col("most")
        per = rows.groupBy("seg", "block").agg(F.sum(part).alias("bound"), F.count(F.when(F.col("term").isin(sorted(must)), 1)).alias("there"))
        return per.where(F.col("there") == len(must)).select("seg", "block", "bound")

    def places(self, terms: list[str], prefixes: list[str], blocks: DataFrame | list | None = None, barred: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """A row for each live chunk with one of the terms, of all blocks or of those given (rows or (seg, block) pairs); and the
        columns with the positions of each (term, False) and (prefix, True)."""
        own = self._blocks_of(blocks)
        slots = [(t, False) for t in terms] + [(p, True) for p in prefixes]
        of = lambda t, prefix: F.startswith("term", F.lit(t)) if prefix else F.col("term") == t
        places = [F.array_sort(F.collect_list(F.when(of(t, p), F.col("pos")))).alias(f"p{i}") for i, (t, p) in enumerate(slots)]
        grouped = self.live(self._by_chunk(self._of_terms(terms, prefixes), own, *places))
        if barred is not None:
            grouped = grouped.join(barred, "doc_id", "left_anti")
        return grouped, {s: F.col(f"p{i}") for i, s in enumerate(slots)}

    @staticmethod
    def _blocks_of(blocks: DataFrame | list | None):
        """A function that keeps the rows of some blocks: of all, of (seg, block) pairs or of rows with these."""
        if blocks is None:
            return lambda rows: rows
        if isinstance(blocks, list):
            each = {}
            for seg, block in blocks:
                each.setdefault(seg, []).append(block)
            chosen = [(F.col("seg") == s) & F.col("block").isin(bs) for s, bs in each.items()]
            return lambda rows: rows.where(reduce(lambda a, b: a | b, chosen, F.lit(False)))
        return lambda rows: rows.join(blocks.select("seg", "block"), ["seg", "block"], "left_semi")

    def _by_chunk(self, rows: DataFrame, own, *what) -> DataFrame:
        """Aggregates ``what`` of (term, pos) by chunk, with seg, row, doc_id, chunk_id and dl, for chunks in some of the posting ``rows``.

        ``own`` keeps the rows of the blocks that count. Rows move whole, once, to where their block's own row is.
        """
        rows = own(rows)
        names = own(self.postings.where(F.col("bucket") == OWN)).join(rows.select("seg", "block").distinct(), ["seg", "block"], "left_semi")
        columns = ["term", "seg", "block", "at", "pos", "docs", "chunks", "dls"]
        both = rows.select(columns).unionByName(names.select(columns)).repartition("seg", "block")
        # Arrays that a row doesn't have are as if empty, so that zipping fills them up with nulls.
        kinds = dict(both.dtypes)
        arrays = [F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in columns[4:]]
        each = both.select("term", "seg", "block", "at", *arrays).select("term", "seg", "block", F.explode(F.arrays_zip("at", *columns[4:])).alias("e")).select("term", "seg", "block", "e.*")
        first = [F.max(F.when(F.col("term").isNull(), F.col(c))).alias(name) for c, name in (("docs", "doc_id"), ("chunks", "chunk_id"), ("dls", "dl"))]
        chunks = each.groupBy("seg", "block", "at").agg(*first, F.count("term").alias("found"), *what).where("found > 0")
        row = F.shiftleft("block", BLOCK_BITS) + F.col("at")
        return chunks.withColumn("row", row).drop("block", "at", "found")

    def hits(self, node, idf: dict[str, float], blocks: DataFrame | list | None = None, barred: DataFrame | None = None) -> DataFrame:
        """(seg, row, doc_id, chunk_id, score) of the chunks that match, of all blocks or of those given."""
        grouped, at = self.places(*_wanted(node), blocks, barred)
        score = F.lit(0.0)
        for t in sorted(match.terms_of(node)):
            score = score + self._part(idf[t], F.size(at[(t, False)]), F.col("dl"))
        return grouped.where(match.compile_places(node, lambda t, p: at[(t, p)])).select("seg", "row", "doc_id", "chunk_id", score.alias("score"))

    def search(self, node, barred: DataFrame | None = None) -> DataFrame:
        """All hits of a query with their scores."""
        if isinstance(node, match.Nothing):
            node = match.Phrase(())
        return self.hits(node, self._idf(match.terms_of(node)), None, barred)

    def top(self, node, k: int, barred: DataFrame | None = None, told: dict | None = None) -> DataFrame:
        """The hits with the k best scores, more where scores are equal; ``told`` gets how many blocks there are and how many were read."""
        idf = self._idf(match.terms_of(node))
        bounds = self.bounds(node, idf)
        count = max(FIRST, k)
        first = bounds.orderBy(F.desc("bound"), "seg", "block").limit(count + 1).collect()
        pairs = [(r["seg"], r["block"]) for r in first[:count]]
        if told is not None:
            told |= {"blocks": len(pairs), "read": len(pairs)}
        if len(first) <= count:
            return self.hits(node, idf, pairs, barred)
        best = [r["score"] for r in self.hits(node, idf, pairs, barred).select("score").orderBy(F.desc("score")).limit(k).collect()]
        if len(best) == k and first[count]["bound"] < best[-1] - 1e-9:
            if told is not None:
                told["blocks"] = bounds.count()
            return self.hits(node, idf, pairs, barred)
        left = bounds.where(F.col("bound") >= best[-1] - 1e-9) if len(best) == k else bounds
        if told is not None:
            told |= {"blocks": bounds.count(), "read": left.count()}
        return self.hits(node, idf, left, barred)


def _wanted(node) -> tuple[list[str], list[str]]:
    """Whole terms and prefixes whose posting lists decide a query; terms that only score are among the whole ones."""
    terms, prefixes = dict.fromkeys(match.terms_of(node)), {}
    for leaf in match.leaves_of(node):
        for p in leaf.phrases if isinstance(leaf, match.Near) else [leaf] if isinstance(leaf, match.Phrase) else []:
            whole = p.tokens[:-1] if p.prefix else p.tokens
            terms |= dict.fromkeys(whole)
            if p.prefix and p.tokens:
                prefixes[p.tokens[-1]] = None
    return list(terms), list(prefixes)
