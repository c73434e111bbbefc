"""Best-fit packing of tokenised documents by a linear grouping scheme.

A document's ids, then END, are cut into pieces of at most CAPACITY ids. Full pieces are sequences
of their own and take no further part. The rest is packed:

1. Lengths above SMALL are large. Sorted by length, they are cut into GROUPS groups of equal
   cardinality; each length counts as the largest of its group, so few sizes remain (groups of
   one size are one).
2. Configurations (how many of each size a sequence holds) are chosen by a bounded knapsack
   over the sizes still left: the fullest configuration, used as often as counts allow.
3. Actual documents are substituted: the r-th document of a group takes its r-th place.
   Documents are no longer than the sizes they stand for, so every sequence fits.
4. What is left free in each sequence is filled with small lengths, best fit: the fullest
   place that can hold the next length, longest first; what fits nowhere opens sequences,
   packed by the same rule.

Only histograms reach the driver: at most CAPACITY lengths, groups and free sizes, whatever
the number of documents. Documents find their place by rank within a length, and ranks come
from counts by (length, bucket); a length has a bucket for each BUCKET_ROWS of its pieces, and
pieces are dealt by row, so neither a common length nor equal rows meet in one task.

Defined results: a null or empty text is the single id END; rows that repeat a doc_id are
packed like any other row (their pieces share doc_id and piece); a null doc_id is packed too;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, released

CAPACITY = 2048
END = 0
#: Lengths over this are large.
SMALL = 512
GROUPS = 1024
#: Pieces of one length aimed at in each bucket within which ranks are counted.
BUCKET_ROWS = 20_000
#: Words, and runs of letters, whose ids a task keeps; words have at most CACHED_CHARS characters.
CACHE, STEMS = 200_000, 300_000
CACHED_CHARS = 64
#: ASCII punctuation.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokens:
    """Ids of whole texts as little-endian bytes, with a bounded cache of the ids of words.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its words in order. Texts with separators that only some definitions count as
    white space are split at the common ones alone.
    """

    _odd = re.compile("[\x1c-\x1f]")
    _common = re.compile(r"[ \t\n\r\x0b\x0c]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        #: The printable stand-in of each byte in the vocabulary.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _stem(self, run: str) -> bytes:
        """Ids of one pretoken in lower case."""
        ids = self.stems.get(run)
        if ids is None:
            if len(self.stems) >= STEMS:
                self.stems.clear()
            seen = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
            ids = self.stems[run] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        return ids

    def _simple(self, word: str) -> bytes | None:
        """Ids of letters and then ASCII punctuation, whose pretokens are these two runs; None for any other word.

        Below U+0250 letters are the same in all Unicode versions and composed already.
        """
        core = word.rstrip(_PUNCTUATION)
        if not core or len(word) > CACHED_CHARS or not core.isalpha() or max(core) >= "\u0250":
            return None
        low = core.lower()
        if len(low) != len(core):
            return None
        return self._stem(low) + self._stem(word[len(core) :]) if len(core) < len(word) else self._stem(low)

    def encode(self, text: str) -> bytes:
        words = [w for w in self._common.split(text) if w] if self._odd.search(text) else text.split()
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:
            pass
        own: dict[str, bytes] = {}
        new = []
        for word in set(words).difference(cache):
            ids = self._simple(word)
            if ids is None:
                new.append(word)
            else:  # the first words seen are the frequent ones; the others cost two look-ups of their runs
                (cache if len(cache) < CACHE else own)[word] = ids
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for word, ids in zip(part, self._encode(part), strict=True):
                (cache if len(word) <= CACHED_CHARS and len(cache) < CACHE else own)[word] = ids
        if not own:
            return b"".join(map(cache.__getitem__, words))
        return b"".join([cache[w] if w in cache else own[w] for w in words])


def _piece_batches(path: str, capacity: int):
    def run(batches):
        import zlib

        tokens = WordTokens(path)
        step = 4 * capacity
        for batch in batches:
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode(text.as_py() or "") + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    docs.append(doc)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((docs, pieces, starts, lengths, crcs), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return got.mapInArrow(released(_piece_batches(path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def group_sizes(counts: dict[int, int], groups: int = GROUPS) -> list[tuple[int, int]]:
    """Linear grouping: counts by length -> (size, count) of groups of equal cardinality, largest first; size is the longest of a group.
    Groups of one size are given as one."""
    total, out, seen = sum(counts.values()), [], 0
    if not total:
        return []
    per = -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = per - seen % per
            if seen % per == 0:
                out.append([length, 0])
            take = min(room, left)
            out[-1][1] += take
            seen += take
            left -= take
    merged: list[list[int]] = []
    for size, n in out:
        if merged and merged[-1][0] == size:
            merged[-1][1] += n
        else:
            merged.append([size, n])
    return [(size, n) for size, n in merged]


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, with each size as often as it is left; bounded knapsack over bit sets.

    The largest size left is always taken once, so that large ones don't remain for last.
    """
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach, steps = 1, []  # bit b: a load of b is possible
    full = (1 << (room + 1)) - 1
    for i in range(len(sizes)):
        n = left[i] - (i == first)
        for _ in range(min(n, room // sizes[i])):
            more = (reach | reach << sizes[i]) & full
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
        if reach >> room & 1:
            break
    load = reach.bit_length() - 1
    taken = [0] * len(sizes)
    taken[first] = 1
    for i, before in reversed(steps):
        if not before >> load & 1:
            taken[i] += 1
            load -= sizes[i]
    return taken


def choose_configurations(groups: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, how many of each group) that together place every large length."""
    sizes, left = [s for s, _ in groups], [n for _, n in groups]
    out = []
    while any(left):
        taken = _fullest(sizes, left, capacity)
        times = min(n // k for n, k in zip(left, taken, strict=True) if k)
        out.append((times, taken))
        left = [n - times * k for n, k in zip(left, taken, strict=True)]
    return out


def best_fit(free: dict[int, int], counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[int]]]:
    """Place lengths (counts) into sequences with room (free: room -> how many), best fit, longest first.

    Returns (room, how many, lengths placed) with distinct histories; the room ``capacity`` stands for new sequences.
    """
    # Sequences of one room and history move together; each step either uses up a class or a length.
    rooms: dict[int, list[list]] = defaultdict(list)  # room left -> [room at first, n, lengths placed]
    done: list[tuple[int, int, list[int]]] = []
    for room, n in free.items():
        rooms[room].append([room, n, []])
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        need = counts[length]
        while need:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            if room is None:
                origin, n, placed = capacity, -(-need // (capacity // length)), []
                room = capacity
            else:
                origin, n, placed = rooms[room].pop()
            # The fullest place stays the fullest after taking one more of this length, if it can.
            fit = min(room // length, need)
            k = min(n, need // fit)
            if k < n:
                rooms[room].append([origin, n - k, list(placed)])
            rooms[room - fit * length].append([origin, k, placed + [length] * fit])
            need -= fit * k
    for classes in rooms.values():
        done += [(origin, n, placed) for origin, n, placed in classes if n and placed]
    return done


def _ranked(rows: DataFrame, key: str, row: str, counts: dict[int, int]) -> DataFrame:
    """Add ``rank`` (from 0) within ``key``, by the distinct numbers ``row``: counts by (key, bucket) give each bucket its first rank."""
    many = [(x, -(-n // BUCKET_ROWS)) for x, n in counts.items() if n > BUCKET_ROWS]
    rows = rows.withColumn("_b", F.lit(0).cast("long"))
    if many:
        buckets = F.broadcast(_plan_frame(rows.sparkSession, many, "_key long, _of long"))
        rows = rows.join(buckets, rows[key] == F.col("_key"), "left").withColumn("_b", F.pmod(F.xxhash64(row), F.coalesce("_of", F.lit(1)))).drop("_key", "_of")
    sizes = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_at", F.sum("_n").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select(key, "_b", F.coalesce("_at", F.lit(0)).alias("_at"))
    own = rows.withColumn("_r", F.row_number().over(W.partitionBy(key, "_b").orderBy(row)) - 1)
    return own.join(before, [key, "_b"]).withColumn("rank", F.col("_at") + F.col("_r")).drop("_b", "_at", "_r")


def _plan_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _place(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Rows with (key, rank) meet the plan's intervals (key, lo, hi, base, per, slot): sequence class and place in it."""
    hit = (rows[key] == plan["p_key"]) & (rows["rank"] >= plan["lo"]) & (rows["rank"] < plan["hi"])
    return rows.join(F.broadcast(plan), hit).withColumn("seq", F.col("base") + ((F.col("rank") - F.col("lo")) / F.col("per")).cast("long")).withColumn("slot", F.col("slot") + (F.col("rank") - F.col("lo")) % F.col("per"))


def pack(cut: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = cut.sparkSession
    whole = materialize(cut.withColumn("row", F.monotonically_increasing_id()))
    order = ["doc_id", "piece", "start", "ids_crc32", "row"]
    full, cut = whole.where(F.col("length") == capacity), whole.where(F.col("length") < capacity)
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than ``capacity`` rows
    large = group_sizes({x: n for x, n in hist.items() if x > small}, groups)
    plan, base = [], 0
    used = [0] * len(large)
    for times, taken in choose_configurations(large, capacity):
        slot = 0
        for g, k in enumerate(taken):
            if k:
                plan.append((g, used[g], used[g] + times * k, base, k, slot))
                used[g] += times * k
                slot += k
        base += times
    # A length's documents may be split between groups: the rank within the length tells which.
    bounds, at = [], defaultdict(int)
    left = {x: n for x, n in hist.items() if x > small}
    for g, (_, n) in enumerate(large):
        filled = 0
        for length in sorted((x for x in left if left[x]), reverse=True):
            take = min(n - filled, left[length])
            if take:
                bounds.append((length, at[length], at[length] + take, g, filled))
                at[length] += take
                left[length] -= take
                filled += take
            if filled == n:
                break
    ranked = materialize(_ranked(cut, "length", "row", hist))
    schema = "p_key long, lo long, hi long, base long, per long, slot long"
    grouped = _plan_frame(spark, bounds, "g_len long, g_lo long, g_hi long, g long, g_at long")
    inside = (ranked["length"] == F.col("g_len")) & (ranked["rank"] >= F.col("g_lo")) & (ranked["rank"] < F.col("g_hi"))
    big = ranked.join(F.broadcast(grouped), inside).withColumn("rank", F.col("g_at") + F.col("rank") - F.col("g_lo")).drop("g_len", "g_lo", "g_hi", "g_at")
    big = materialize(_place(big, _plan_frame(spark, plan, schema), "g").select(*order, "length", "seq", "slot"))
    # Room left in each sequence; its histogram plans the small lengths.
    free = materialize(big.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0"))
    rooms = {r["room"]: r["n"] for r in free.groupBy("room").agg(F.count("*").alias("n")).collect()}
    free = materialize(_ranked(free, "room", "seq", rooms).select("room", "seq", "rank"))
    low = min((x for x in hist if x <= small), default=capacity + 1)
    filled = best_fit({r: n for r, n in rooms.items() if r >= low}, {x: n for x, n in hist.items() if x <= small}, capacity)
    fill, homes = [], []
    room_at, length_at = defaultdict(int), defaultdict(int)
    for c, (room, n, placed) in enumerate(filled):
        if room == capacity:
            homes.append((c, -1, 0, 0, base))
            base += n
        else:
            homes.append((c, room, room_at[room], room_at[room] + n, -1))
            room_at[room] += n
        slot = 0
        for length in sorted(set(placed), reverse=True):
            k = placed.count(length)
            fill.append((length, length_at[length], length_at[length] + n * k, c, k, slot))
            length_at[length] += n * k
            slot += k
    # Class c and number within it name a sequence: a new one, or the one of that rank among those with this room.
    tiny = _place(ranked.where(F.col("length") <= small), _plan_frame(spark, [(a, b, e, 0, k, s, c) for a, b, e, c, k, s in fill], schema + ", c long"), "length")
    home = _plan_frame(spark, homes, "h_c long, h_room long, h_lo long, h_hi long, h_base long")
    tiny = tiny.join(F.broadcast(home), F.col("c") == F.col("h_c")).withColumn("f_rank", F.col("h_lo") + F.col("seq"))
    spots = free.select(F.col("room").alias("h_room"), F.col("rank").alias("f_rank"), F.col("seq").alias("f_seq"))
    tiny = tiny.join(spots, ["h_room", "f_rank"], "left")
    tiny = tiny.withColumn("seq", F.when(F.col("h_room") < 0, F.col("h_base") + F.col("seq")).otherwise(F.col("f_seq"))).withColumn("slot", F.col("slot") + capacity)
    both = big.select(*order, "length", "seq", "slot").unionByName(tiny.select(*order, "length", "seq", "slot"))
    run = W.partitionBy("seq").orderBy("slot", "row").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)))
    both = both.unionByName(full.withColumn("seq", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")), allowMissingColumns=True)
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path()))
