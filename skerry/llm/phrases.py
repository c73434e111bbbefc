"""Phrase collocations: n-grams of dictionary ids in fixed-width keys, range-partitioned, radix-sorted and counted by runs.

1. Words are counted by language; those that occur MIN_COUNT times make the dictionary (a phrase
   with a rarer word is rarer than that itself). Ids are ranks by count over all languages.
2. Texts are written as ids. Punctuation, line ends and words outside the dictionary break
   pieces. At each place the next LONGEST ids of the piece, filled with zeros, are one key of
   4 bytes an id: its prefixes are all phrases that start there. Tasks sort and count CHUNK keys
   at a time before anything is written.
3. Keys are range-partitioned over Spark. A task radix-sorts its range (16 bits a pass, last
   digit first) and counts the runs of each prefix length. A prefix that lies within a range is
   counted in full there and goes if it is rare; the prefixes at a range's ends are passed on
   whatever their counts, and an aggregation joins their parts. So a phrase that a third of all
   places share is one key of each chunk, and a range may divide it anywhere.
4. Scores by the weakest cut, dropping of phrases within longer ones, and the order by language
   are joins and aggregations of the phrases left (no more than words / MIN_COUNT * 3).

The dictionary goes to the tasks as a broadcast up to DICTIONARY words; a larger one is joined
with the words by a shuffle. Everything counted is exact, products are decimals of 38 digits.

Defined results: a null text has no words, a null language is UNKNOWN; repeated rows count again;
ties of score go by count, then by phrase in UTF-8 order; an empty table gives an empty result;
very long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, numbered, released, scratch

MIN_COUNT, LONGEST, TOP = 30, 4, 2_000
UNKNOWN = "und"
#: Words in the dictionary that go to tasks by broadcast.
DICTIONARY = 1_000_000
#: Keys that a task sorts at a time, and keys aimed at in a range; distinct words held while counting.
CHUNK, RANGE, HELD = 500_000, 1_000_000, 300_000
#: Ranges' sizes that a task sorts at a time at most.
RANGES = 3
#: Bytes of text that are words at a time, rows of a table whose texts are held, and rows of keys sent on at a time.
BYTES, TEXTS, SENT = 1_000_000, 1_000, 50_000
#: A phrase goes if a longer candidate around it has this share of its count, in percent.
INSIDE = 80
SCALE = 2_000_000
#: What ends a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_AS_WORDS = bytes(_LOWER.get(c, ord(" ") if c in BREAKS else c) for c in range(256))
_AS_PIECES = bytes(_LOWER.get(c, ord("\n") if c in BREAKS else ord(" ") if c == ord("\t") else c) for c in range(256))


def _slices(data: bytes):
    """``data`` in slices of about BYTES, cut at spaces."""
    start = 0
    while len(data) - start > BYTES:
        end = data.rfind(b" ", start, start + BYTES)
        end = end if end >= start else data.find(b" ", start + BYTES)
        if end < 0:
            break
        yield data[start:end]
        start = end + 1
    yield data[start:]


def _groups(texts: list[bytes]):
    """Neighbouring texts joined by line ends, up to about BYTES at a time; a longer one alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > BYTES:
            yield b"\n".join(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    yield b"\n".join(group)


def _parts(batch: pa.RecordBatch, rows: int):
    """``batch`` in slices of ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _by_language(batch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            texts.setdefault(UNKNOWN if lang is None else lang, []).append(text.encode())
    return texts


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n), and a row with a null word for each language's total."""

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in (part for whole in batches for part in _parts(whole, TEXTS)):
            for lang, texts in _by_language(batch).items():
                counts = held.setdefault(lang, Counter())
                for group in _groups(texts):
                    for part in _slices(group.translate(_AS_WORDS)):
                        counts.update(part.split())  # at the six ASCII spaces; those that end a piece are plain spaces here
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    def _rows(held):
        for lang, counts in held.items():
            words = pa.array([*counts, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1)), words, pa.array([*counts.values(), counts.total()], pa.int64())], ["lang", "word", "n"])

    each = docs.select("lang", "text").mapInArrow(released(run), "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    """Ids of words; 0, which breaks a piece, for the others."""

    def __missing__(self, word):
        return 0


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of unsigned 32-bit columns, the first one the most significant."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16) if len(column) and column.max() >> 16 else (0,):
            digit = (column >> shift).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def keys_of(ids: np.ndarray, longest: int, places: int | None = None) -> list[np.ndarray]:
    """The columns of the keys at the (first ``places``) places of a sequence of ids (0: a break) where a phrase of two words or more starts."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)]).astype(np.uint32)
    columns = [padded[: len(ids)]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] > 0, padded[k : k + len(ids)], 0).astype(np.uint32))
    starts = np.flatnonzero(columns[1][:places])
    return [c[starts] for c in columns]


def _packed(columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    """Rows of a binary key (4 bytes an id, most significant first) and a count."""
    width = 4 * len(columns)
    data = np.stack(columns, axis=1).astype(">u4").tobytes()
    offsets = np.arange(len(n) + 1, dtype=np.int32) * width
    key = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64())], ["key", "n"])


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _counted(columns: list[np.ndarray]) -> pa.RecordBatch:
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    starts = _runs(columns)
    return _packed([c[starts] for c in columns], np.diff(starts, append=len(order)))


def _key_counts(sequences, longest: int):
    """Batches of (key, n) from arrays of ids, CHUNK keys sorted at a time; a longer array is taken in pieces."""
    held: list[list[np.ndarray]] = []
    n = 0
    for ids in sequences:
        for columns in _key_pieces(ids, longest):
            held.append(columns)
            n += len(columns[0])
            if n >= CHUNK:
                yield from _parts(_counted(_joined(held)), SENT)
                n = 0
    if n:
        yield from _parts(_counted(_joined(held)), SENT)


def _key_pieces(ids: np.ndarray, longest: int):
    """:func:`keys_of` of a long array, CHUNK places at a time; each piece sees the ids after it."""
    for at in range(0, len(ids), CHUNK):
        yield keys_of(ids[at : at + CHUNK + longest - 1], longest, CHUNK)


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of all of ``held``, which is emptied."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()
    return columns


_KEYS = "key binary, n long"


def keys_by_broadcast(docs: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """Counted keys of all texts; ``dictionary``: (lang, word, id), at most DICTIONARY rows."""
    ids: dict[str, _Ids] = {}
    for r in dictionary.select("lang", "word", "id").toLocalIterator():
        ids.setdefault(r["lang"], _Ids({b"": -1, b"\n": 0}))[r["word"].encode()] = r["id"]
    sent = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        known = sent.value

        def sequences():
            for batch in (part for whole in batches for part in _parts(whole, TEXTS)):
                for lang, texts in _by_language(batch).items():
                    if lang in known:
                        for group in _groups(texts):
                            parts = []
                            for part in _slices(group.translate(_AS_PIECES).replace(b"\n", b" \n ")):
                                tokens = part.split(b" ")
                                found = np.fromiter(map(known[lang].__getitem__, tokens), np.int64, len(tokens))
                                parts.append(found[found >= 0].astype(np.uint32))
                            yield np.concatenate(parts)

        yield from _key_counts(sequences(), longest)

    return docs.select("lang", "text").mapInArrow(released(run), _KEYS)


def keys_by_join(docs: DataFrame, dictionary: DataFrame, longest: int) -> DataFrame:
    """The same with a dictionary of any size: words meet their ids in a join, and texts are put together again by place."""

    def places(batches):
        for batch in batches:
            for row, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at, words, where = 0, [], []
                for piece in (text or "").encode().translate(_AS_PIECES).split(b"\n"):
                    for word in piece.split():
                        words.append(word)
                        where.append(at)
                        at += 1
                    at += 1  # the next word does not follow
                lang = UNKNOWN if lang is None else lang
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(where, pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string())], ["row", "at", "lang", "word"])

    def run(batches):
        def sequences():
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    at, ids = np.array([x["at"] for x in text], np.int64), np.array([x["id"] for x in text], np.int64)
                    gap = np.flatnonzero(np.diff(at) > 1) + 1
                    yield np.append(np.insert(ids, gap, 0), 0)

        yield from _key_counts(sequences(), longest)

    words = docs.select(F.monotonically_increasing_id().alias("row"), "lang", "text").mapInArrow(released(places), "row long, at long, lang string, word string")
    found = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"))
    return found.select("ids").mapInArrow(released(run), _KEYS)


def count_phrases(keys: DataFrame, longest: int, min_count: int) -> DataFrame:
    """(key, n): phrases of 2 to ``longest`` ids that occur ``min_count`` times, from counted keys."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        whole, size = True, 0
        for batch in batches:
            if batch.num_rows:
                held.append(_columns(batch))
                size += batch.num_rows
            if size >= RANGES * RANGE:  # a range far over its size: counted in pieces, so nothing is known to be complete
                whole = False
                yield from _prefix_counts(held, False)
                size = 0
        if held:
            yield from _prefix_counts(held, whole)

    def _columns(batch):
        key = batch.column(0)
        offset = np.frombuffer(key.buffers()[1], np.int32)[key.offset : key.offset + len(key) + 1]
        rows = np.frombuffer(key.buffers()[2], np.uint8)[offset[0] : offset[-1]].view(">u4").reshape(len(key), longest)
        return [*(rows[:, k].astype(np.uint32) for k in range(longest)), batch.column(1).to_numpy()]

    def _prefix_counts(held, whole):
        columns = _joined(held)
        n = columns.pop()
        order = radix_order(columns)
        columns, n = [c[order] for c in columns], n[order]
        for length in range(2, longest + 1):
            starts = _runs(columns[:length])
            total = np.add.reduceat(n, starts)
            wanted = total >= min_count
            if whole:
                wanted[[0, -1]] = True
            else:
                wanted[:] = True
            wanted &= columns[length - 1][starts] > 0
            yield from _parts(_packed([c[starts][wanted] for c in columns[:length]], total[wanted]), SENT)

    ranges = max(1, -(-keys.count() // RANGE))
    spark = keys.sparkSession
    ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = keys.repartitionByRange(ranges, "key").mapInArrow(released(run), _KEYS)
    return parts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _size(key: str) -> Column:
    """How many ids a key holds."""
    return F.shiftright(F.length(key), 2)


def _id_at(key: str, place) -> Column:
    return F.conv(F.hex(F.substring(F.col(key), place * 4 + 1, F.lit(4))), 16, 10).cast("long")


def weakest_cuts(phrases: DataFrame, words: DataFrame, scale: int = SCALE) -> DataFrame:
    """(key, n, l, r, score): the cut of each phrase with the lowest score, the first of those. ``words``: (key, n) of single ids."""
    parts = phrases.unionByName(words)
    cut = phrases.select("key", "n", F.explode(F.sequence(F.lit(1), _size("key") - 1)).alias("k"))
    cut = cut.select("key", "n", "k", F.substring(F.col("key"), F.lit(1), F.col("k") * 4).alias("first"), F.substring(F.col("key"), F.col("k") * 4 + 1, F.length("key")).alias("rest"))
    cut = cut.join(parts.select(F.col("key").alias("first"), F.col("n").alias("l")), "first").join(parts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr(f"{scale} * CAST(n AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cut.groupBy("key", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("key", "n", "c.l", "c.r", "c.score")


def outermost(phrases: DataFrame, percent: int = INSIDE) -> DataFrame:
    """Phrases that no longer phrase around them has ``percent`` of their count or more."""
    ids = _size("key")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), ids - 1), lambda size: F.transform(F.sequence(F.lit(0), ids - size), lambda at: F.substring(F.col("key"), at * 4 + 1, size * 4))))
    around = phrases.where(F.length("key") > 8).select(F.explode(spans).alias("key"), "n").groupBy("key").agg(F.max("n").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    got = phrases.join(around, "key", "left")
    return got.where(F.col("around").isNull() | (100 * wide("around") < percent * wide("n"))).select("key", "n")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    with scratch() as keep:
        counted = materialize(count_words(docs).where(F.col("word").isNull() | (F.col("n") >= min_count)))
        totals = keep(materialize(counted.where("word IS NULL").select("lang", F.col("n").alias("total"))))
        frequent = counted.where("word IS NOT NULL")
        dictionary = keep(materialize(numbered(frequent, F.desc("n"), "lang", "word").select("lang", "word", "n", (F.col("rank") + 1).alias("id"))))
        size = dictionary.count()
        keys = materialize((keys_by_broadcast if size <= DICTIONARY else keys_by_join)(docs, dictionary, longest))
        phrases = materialize(count_phrases(keys, longest, min_count))
        singles = dictionary.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "n")
        left = outermost(phrases)
        best = keep(materialize(weakest_cuts(phrases, singles).join(left.select("key"), "key", "left_semi")))
    spelled = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), _size("key") - 1), lambda i: _id_at("key", i))).alias("at", "id"))
    spelled = spelled.join(dictionary.select("id", "lang", "word"), "id").groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = best.join(spelled, "key")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SUB = " UNION ALL ".join(f"SELECT lang, c, array_to_string(ws[{i}:{i + size - 1}], ' ') AS p FROM t WHERE len = {n}" for n in range(3, LONGEST + 1) for size in range(2, n) for i in range(1, n - size + 2))
_CUT = " UNION ALL ".join(f"SELECT *, {k} AS k, array_to_string(ws[1:{k}], ' ') AS head, array_to_string(ws[{k + 1}:], ' ') AS tail FROM t WHERE len > {k}" for k in range(1, LONGEST))
SQL = f"""WITH pc AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pc),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS MATERIALIZED (SELECT lang, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3, unnest(ws[4:]) AS w4 FROM w),
f AS MATERIALIZED (SELECT lang, 1 AS len, w1 AS p, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS MATERIALIZED (SELECT *, string_split(p, ' ') AS ws FROM f WHERE len > 1),
sub AS ({_SUB}), inside AS (SELECT lang, p, max(c) AS around FROM sub GROUP BY ALL),
cut AS ({_CUT}), cuts AS (SELECT cut.lang, cut.p, cut.c AS a, k, x.c AS l, y.c AS r, ({SCALE}::HUGEINT * cut.c) // (x.c + y.c) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.p = cut.head JOIN f y ON y.lang = cut.lang AND y.p = cut.tail),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, p) WHERE around IS NULL OR 100::HUGEINT * around < {INSIDE}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) QUALIFY rank <= {TOP}"""
