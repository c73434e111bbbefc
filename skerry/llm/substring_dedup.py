"""Substring dedup: remove words in windows that an earlier document holds too.

A window is WINDOW consecutive words of one document. A word is removed if a window that
covers it has a word sequence that also starts in a document with a smaller doc_id; windows
are judged on the input.

Two entry points:

* :func:`strip_reference` removes what a bounded reference set holds: one suffix automaton for
  each shard of the reference, broadcast, streamed over for matching statistics.
* :func:`dedup` removes what the corpus itself repeats. There the reference is the whole
  corpus, so shards of it have no size bound that would allow a broadcast, and each document
  would have to be streamed through all of them. Instead, documents are cut where their own
  content says so: each window is named by its anchor, the least hash of its ANCHOR-word
  grams. Equal windows have equal anchors. Runs of windows with one anchor are segments. An
  aggregation over (anchor, segment hash) finds the least doc_id of each distinct segment: in
  any later document the whole segment is removed. A distinct segment whose anchor also
  occurs in other segments is judged once, for one place in its first document; the segments
  of an anchor are a shard, whose suffix automaton decides their windows (see
  :func:`_judge_shard`), and the decision is handed to all places of that document. Hot
  passages and copies collapse in map-side aggregation; a shard of more than ``max_group``
  segments is dealt into parts with an automaton each, and the windows that these leave, each
  once a part, meet by hash.

Hashes: segments are compared by anchor and segment hash together, 128 bits that both depend
on the content; the automata compare 64-bit word hashes.

Defined results: a null text has no words; an empty or short text loses nothing; rows with a
null doc_id are neither reduced nor the cause of a removal; rows that repeat a doc_id never
remove from each other (rows that repeat text too share their result); an empty table gives
an empty result; further columns are kept by :func:`apply` and ignored by :func:`dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, released, scratch

WINDOW = 50
ANCHOR = 8
#: A side of a join is broadcast up to so many bytes by its measured count, else it is shuffled.
BROADCAST_BYTES = 32 << 20
#: Reference words in one automaton of strip_reference().
SHARD_WORDS = 200_000

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: The inverse of _M1 modulo 2^64.
_M1_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BASE = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window: the least mixed hash of its ``anchor``-word grams."""
    grams = np.zeros(len(h) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = grams * _BASE + h[k : len(h) - anchor + 1 + k]
    low, span, want = _mix(grams), 1, window - anchor + 1
    while span < want:
        step = min(span, want - span)
        low, span = np.minimum(low[: len(low) - step], low[step:]), span + step
    return low


def segments(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor: anchor, hash of the words covered, first window, number of windows."""
    low = window_anchors(h, window, anchor)
    starts = np.concatenate(([0], np.nonzero(low[1:] != low[:-1])[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(low)])))
    # Prefix sums of position-weighted hashes would let overlaps cancel; a polynomial over whole segments doesn't.
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), _M1, np.uint64))))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h) * powers[: len(h)])))
    ends = starts + sizes + window - 1
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(starts[-1]), _M1_INVERSE, np.uint64))))
    seg = (prefix[ends] - prefix[starts]) * back[starts] + _mix(sizes.astype(np.uint64))  # as if each began its document
    return low[starts], seg, starts, sizes


def _segment_batches(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            parts: list = [[], [], [], [], [], []]
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = split_words(text.as_py())
                if doc is None or len(words) < window:
                    continue
                low, seg, starts, sizes = segments(word_hashes(words), window, anchor)
                for part, x in zip(parts, (low.view(np.int64), seg.view(np.int64), np.full(len(low), doc), np.full(len(low), th), starts.astype(np.int32), sizes.astype(np.int32)), strict=True):
                    part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=["anchor", "seg", "doc_id", "th", "start", "n"])

    return run


class SuffixAutomaton:
    """Suffix automaton over integer symbols, with the least label of the texts that reach each state.

    Labels must be added in ascending order: a state keeps the label of the text that made it,
    which is the least of all that hold its sequences.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.label = [-1], [0], [None]
        self.last = 0

    def _state(self, length: int, nxt: dict[int, int], link: int, label) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.label.append(label)
        return len(self.len) - 1

    def start(self) -> None:
        """The next symbol begins a new text."""
        self.last = 0

    def add(self, symbol: int, label) -> None:
        nxt, link, length = self.next, self.link, self.len
        p = self.last
        if symbol in nxt[p]:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                self.last = q
                return
            clone = self._state(length[p] + 1, dict(nxt[q]), link[q], self.label[q])
            link[q] = clone
            while p != -1 and nxt[p].get(symbol) == q:
                nxt[p][symbol] = clone
                p = link[p]
            self.last = clone
            return
        cur = self._state(length[p] + 1, {}, 0, label)
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = self._state(length[p] + 1, dict(nxt[q]), link[q], self.label[q])
                link[q] = link[cur] = clone
                while p != -1 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
        self.last = cur

    def matches(self, symbols, at_least: int):
        """Matching statistics: each place where the longest suffix that the texts hold has ``at_least`` symbols, with
        the label of the state of exactly that many."""
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        for i, s in enumerate(symbols):
            while state and s not in nxt[state]:
                state = link[state]
                matched = length[state]
            if s in nxt[state]:
                state = nxt[state][s]
                matched += 1
            if matched >= at_least:
                at = state
                while length[link[at]] >= at_least:
                    at = link[at]
                yield i, self.label[at]
                state, matched = at, at_least  # longer matches change nothing


def _spans(found: list[int], window: int) -> list[list[int]]:
    """First windows of matches, ascending -> maximal word spans [start, end)."""
    out: list[list[int]] = []
    for s in found:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return out


def _judge_shard(rows: list[tuple[int, np.ndarray]], window: int) -> list[list[int]]:
    """Distinct segments of one anchor as (first doc_id, word hashes) -> for each, the windows that an earlier document holds.

    All windows of these segments share the anchor, so every earlier first occurrence is here.
    Texts stream through the automaton in the order of their documents; those of one document
    are matched before any of them is added.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    auto, out = SuffixAutomaton(), [[] for _ in rows]
    for i in order:
        doc, symbols = rows[i][0], rows[i][1].tolist()
        out[i] = [e - window + 1 for e, label in auto.matches(symbols, window) if label < doc]
        auto.start()
        for s in symbols:
            auto.add(s, doc)
    return out


def _segment_words(window: int):
    """Documents with spans of first segments -> (anchor, part, seg, doc_id, symbols) for each; copies of a document count once a task."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            keys: list = [[], [], [], []]
            symbols: list = []
            for doc, th, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if (doc, th) in seen:
                    continue
                seen.add((doc, th))
                h = word_hashes(split_words(text.as_py())).view(np.int64)
                for span in spans:
                    for k, x in zip(keys, (span["anchor"], span["part"], span["seg"], doc), strict=True):
                        k.append(x)
                    symbols.append(h[span["start"] : span["start"] + span["n"] + window - 1])
            if symbols:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in symbols]))).astype(np.int32)
                cols = [pa.array(k, t) for k, t in zip(keys, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(symbols)))], names=["anchor", "part", "seg", "doc_id", "symbols"])

    return run


def _window_hashes(symbols: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    h = symbols.view(np.uint64)
    n = len(h) - window + 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(window):
        a = a * _BASE + h[k : k + n]
        b = b * _M2 + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(17)))
    return _mix(a).view(np.int64), _mix(b).view(np.int64)


def _shard_batches(window: int):
    """Rows of _segment_words() sorted by anchor, part and segment -> (anchor, seg, doc_id, s, e, h1, h2), places counted from the segment's start.

    Spans that an earlier document of the shard holds have no hashes. Where an anchor's segments were dealt into parts,
    each other window is returned with its hashes: an earlier document of another part may hold it.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def judged(key: tuple, group: list) -> list[tuple]:
        out, cut = [], key is not None and key[1] >= 0
        if len(group) > 1 or cut:
            for (seg, doc, symbols), found in zip(group, _judge_shard([(g[1], g[2]) for g in group], window), strict=True):
                out += [(key[0], seg, doc, s, e, None, None) for s, e in _spans(found, window)]
                if cut:
                    gone = set(found)
                    h1, h2 = (x.tolist() for x in _window_hashes(symbols, window))
                    out += [(key[0], seg, doc, k, k + window, h1[k], h2[k]) for k in range(len(h1)) if k not in gone]
        return out

    def batch_of(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "seg", "doc_id", "s", "e", "h1", "h2"])

    def run(batches):
        group: list = []
        key = None
        for batch in batches:
            rows: list = []
            lists = batch.column(4)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (anchor, part, seg, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (anchor, part) != key:
                    rows += judged(key, group)
                    key, group = (anchor, part), []
                if not group or group[-1][0] != seg:
                    group.append((seg, doc, values[offsets[k] : offsets[k + 1]].copy()))
                if len(rows) > 100_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        if rows := judged(key, group):
            yield batch_of(rows)

    return run


def _with_side(docs: DataFrame, side: DataFrame, spans: str, how: str) -> DataFrame:
    """Join documents with a table of a few spans each: broadcast if its measured size allows, else shuffled."""
    n, total = side.agg(F.count("*"), F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()
    return docs.join(F.broadcast(side) if n * 64 + total * 24 <= BROADCAST_BYTES else side, ["doc_id", "th"], how)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells rows that repeat a doc_id with other text apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def removed_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_group: int = 256) -> DataFrame:
    """(doc_id, th, spans array<struct<s,e>>): word spans to remove from each document that loses any."""
    base = keyed(docs)
    occ = materialize(base.mapInArrow(released(_segment_batches(window, anchor)), "anchor long, seg long, doc_id long, th long, start int, n int"))
    segs = occ.groupBy("anchor", "seg").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = segs.groupBy("anchor").agg(F.count("*").alias("nseg"), F.min("lo").alias("alo"), F.max("hi").alias("ahi")).where("nseg > 1 AND alo < ahi")
    flagged = segs.join(shared.select("anchor", "nseg"), "anchor", "left").where("hi > lo OR nseg IS NOT NULL").select("anchor", "seg", "lo", "nseg")
    got = materialize(occ.join(flagged, ["anchor", "seg"]).where("doc_id > lo OR nseg IS NOT NULL"))
    later = got.where("doc_id > lo").select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("n") + window - 1).alias("e"))
    first = got.where("doc_id = lo")

    # The segments of one anchor are one shard; those of a hot one are dealt into parts of about max_group each.
    part = F.when(F.col("nseg") > max_group, F.pmod(F.xxhash64("seg"), F.ceil(F.col("nseg") / max_group)).cast("int")).otherwise(F.lit(-1))
    once = first.dropDuplicates(["anchor", "seg"]).withColumn("part", part)
    side = once.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "part", "seg", "start", "n")).alias("todo"))
    shards = _with_side(base, side, "todo", "inner").select("doc_id", "th", "text", "todo").mapInArrow(released(_segment_words(window)), "anchor long, part int, seg long, doc_id long, symbols array<long>")
    shards = shards.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "seg")
    found = materialize(shards.mapInArrow(released(_shard_batches(window)), "anchor long, seg long, doc_id long, s int, e int, h1 long, h2 long"))
    # Between parts: what each has left once meets by hash.
    left = found.where("h1 IS NOT NULL")
    least = left.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("hi > lo").select("h1", "h2", "lo")
    more = left.join(least, ["h1", "h2"]).where("doc_id > lo")
    spans = found.where("h1 IS NULL").select("anchor", "seg", "s", "e").unionByName(more.select("anchor", "seg", "s", "e"))
    spans = first.select("anchor", "seg", "doc_id", "th", "start").join(spans, ["anchor", "seg"]).select("doc_id", "th", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    return later.unionByName(spans).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.pandas_udf(_CUT)
def _cut(text, spans):
    import pandas as pd

    rows = []
    for t, flat in zip(text, spans, strict=True):
        words = split_words(t)
        if flat is None or not len(flat):
            rows.append((len(words), 0, b" ".join(words)))
            continue
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, np.asarray(flat[0::2]), 1)
        np.add.at(gone, np.asarray(flat[1::2]), -1)
        stays = (np.cumsum(gone)[:-1] == 0).tolist()
        kept = [w for w, s in zip(words, stays, strict=True) if s]
        rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
    pa.default_memory_pool().release_unused()
    return pd.DataFrame([(a, b, c.decode("utf-8", "surrogatepass")) for a, b, c in rows], columns=["n_words", "n_removed", "kept"])


_cut = _cut.asNondeterministic()  # else a filter on its result would run it a second time


def _flat(spans):
    return F.flatten(F.transform(spans, lambda x: F.array(x["s"], x["e"])))


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_group: int = 256) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    with scratch() as keep:
        spans = keep(materialize(removed_spans(docs, window, anchor, max_group)))
    joined = _with_side(keyed(docs), spans, "spans", "left")
    return joined.select("doc_id", _cut("text", _flat(F.col("spans"))).alias("c")).select("doc_id", "c.*")


def apply(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with repeated passages removed; documents that lose nothing keep their text as it is, those that lose all go."""
    with scratch() as keep:
        spans = keep(materialize(removed_spans(docs, window, anchor)))
    spans = spans.select(F.col("doc_id").alias("_skerry_id"), F.col("th").alias("_skerry_th"), "spans")
    spans = spans.select("_skerry_id", "_skerry_th", _flat(F.col("spans")).alias("_skerry_spans"))
    joined = docs.join(spans, (docs["doc_id"] == F.col("_skerry_id")) & (F.xxhash64(docs["text"]) == F.col("_skerry_th")), "left")
    cut = F.when(F.col("_skerry_spans").isNotNull(), _cut(docs["text"], F.col("_skerry_spans"))["kept"]).otherwise(docs["text"])
    out = joined.withColumn("_skerry_text", cut).where("_skerry_spans IS NULL OR _skerry_text <> ''")
    cols = [F.col("_skerry_text").alias("text") if c == "text" else F.char_length("_skerry_text").cast(t).alias(c) if c == "n_chars" else docs[c] for c, t in docs.dtypes]
    return out.select(*cols)


def strip_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, max_words: int = 5_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept: words of matches of ``window`` words or more with a bounded reference (text) go.

    The reference is checked to hold at most ``max_words`` words before it is gathered; its shards' automata are broadcast.
    """
    from .common import words as word_array

    n = reference.agg(F.coalesce(F.sum(F.size(word_array(F.col("text")))), F.lit(0))).first()[0]
    if n > max_words:
        raise ValueError(f"the reference has {n} words; at most {max_words} can be broadcast. Use dedup() over both tables")
    shards, size = [SuffixAutomaton()], 0
    for row in reference.select("text").toLocalIterator():
        if size > SHARD_WORDS:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].start()
        for s in word_hashes(split_words(row[0])).tolist():
            shards[-1].add(s, 0)
            size += 1
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def spans(text):
        import pandas as pd

        out = []
        for t in text:
            h = word_hashes(split_words(t)).tolist()
            found = sorted({e - window + 1 for shard in sent.value for e, _ in shard.matches(h, window)})
            out.append([x for span in _spans(found, window) for x in span])
        return pd.Series(out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("spans", spans("text")).select("doc_id", _cut("text", "spans").alias("c")).select("doc_id", "c.*")
