"""License scans: which documents hold which license templates.

Template texts and documents are cut into word shingles of SHINGLE words (lower case, letters
and digits only; version numbers count as words). Each template is cut into overlapping
windows; so is each document, with windows of every length class that templates have. MinHash
bands over a window's shingles retrieve template windows; exact containment of the template's
shingles in the document then decides.

Band settings: with ROWS rows and BANDS bands a window pair of similarity s is retrieved with
probability 1 - (1 - s^ROWS)^BANDS; :func:`band_settings` takes the least number of bands for
which that is at least PROBABILITY at s = THRESHOLD / (2 - THRESHOLD), the similarity of windows
of one length that share THRESHOLD (0.8) of their shingles. A document that holds a template in
one piece also has a window equal to the template's, which is always retrieved.

The templates are a parameter of bounded size (checked), so they are broadcast; a worker keeps
its index between tasks. Documents are streamed; nothing is gathered by key. The shingles of
many documents are hashed in one array; windows that cross from one into the next only add
candidates, which the exact containment judges.

Defined results: a null or wordless text matches nothing and gives no row; of templates of one
license that a text holds, the largest share is given; a template of fewer than SHINGLE words is
its whole word sequence; a very long text is scanned whole; rows with null or repeated ids are
scanned like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .license_texts import TEMPLATES

SHINGLE = 5
THRESHOLD = 0.8
PROBABILITY = 0.999
ROWS = 2
#: Words of a template window; templates up to this length are one window.
WINDOW = 64
MAX_TEMPLATE_WORDS = 2_000_000
#: Word hashes that a worker keeps.
CACHE = 400_000

#: Characters of texts whose windows are hashed together.
CHUNK_CHARS = 1_000_000

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def license_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def band_settings(threshold: float = THRESHOLD, probability: float = PROBABILITY, rows: int = ROWS) -> int:
    """The least number of bands that retrieves windows that share ``threshold`` of their shingles with the probability."""
    import math

    return math.ceil(math.log(1 - probability) / math.log(1 - (threshold / (2 - threshold)) ** rows))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_KNOWN = _WordHashes()


def _hashes(words: list[str], shingle: int) -> np.ndarray:
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    if len(h) < shingle:
        h = np.concatenate((h, np.zeros(shingle - len(h), np.uint64)))
    out = np.zeros(len(h) - shingle + 1, np.uint64)
    for k in range(shingle):
        out = out * np.uint64(0x100000001B3) + h[k : len(h) - shingle + 1 + k]
    return out


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _joined(key, low):
    """The key of a band's minima so far, and one more."""
    return low * np.uint64(0xC2B2AE3D27D4EB4F) if key is None else (key + low) * np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Band tables of the templates' windows, by number of shingles in a window."""

    def __init__(self, templates: list[tuple[str, str]], shingle: int = SHINGLE, window: int = WINDOW, rows: int = ROWS, bands: int | None = None):
        self.shingle, self.rows, self.bands = shingle, rows, bands or band_settings(rows=rows)
        self.seeds = list(range(1, self.rows * self.bands + 1))
        self.names = [name for name, _ in templates]
        self.shingles = [frozenset(_hashes(license_words(text), shingle).tolist()) for _, text in templates]
        self.size = [len(license_words(text)) for _, text in templates]
        # Windows have a power of two of shingles, so the minima of one length come from those of the one below.
        self.tables: dict[int, list[dict[int, set[int]]]] = {}
        for t, (_, text) in enumerate(templates):
            h = _hashes(license_words(text), shingle)
            if not license_words(text):
                continue
            span = 1 << (min(len(h), window - shingle + 1).bit_length() - 1)
            table = self.tables.setdefault(span, [defaultdict(set) for _ in range(self.bands)])
            for at in sorted({*range(0, len(h) - span + 1, max(1, span // 2)), len(h) - span}):
                for b in range(self.bands):
                    table[b][self._window_key(h[at : at + span], b)].add(t)
        self.spans = sorted(self.tables)
        #: Which top bits of a key any listed key has.
        self.marks = {}
        for span, table in self.tables.items():
            for b, keys in enumerate(table):
                mark = self.marks[span, b] = np.zeros(1 << 16, bool)
                mark[np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(48)] = True

    def _window_key(self, h: np.ndarray, band: int) -> int:
        """The key of one window's shingles in a band."""
        key = None
        for seed in self.seeds[band * self.rows : (band + 1) * self.rows]:
            key = _joined(key, _mixed(h, seed).min(keepdims=True))
        return int(key[0])

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> list[set[int]]:
        """For each text, whose shingles begin at ``starts`` in ``h``, the templates of which a window shares a band."""
        found: list[set[int]] = [set() for _ in starts]
        sizes = np.diff(np.concatenate((starts, [len(h)])))
        for b in range(self.bands):
            keys, least = {}, {}
            for seed in self.seeds[b * self.rows : (b + 1) * self.rows]:
                low, have = _mixed(h, seed), 1
                whole = np.minimum.reduceat(low, starts)
                for span in self.spans:
                    while have < span and len(low) > 1:
                        step = min(have, len(low) - 1)
                        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
                    keys[span] = _joined(keys.get(span), low)
                    least[span] = _joined(least.get(span), whole)
            for span in self.spans:
                table, mark = self.tables[span][b], self.marks[span, b]
                at = np.nonzero(mark[keys[span] >> np.uint64(48)])[0]
                for k, doc in zip(keys[span][at].tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                    found[doc] |= table.get(k, _NONE)
                # A text with fewer shingles is one window.
                for doc in np.nonzero(mark[least[span] >> np.uint64(48)] & (sizes < span))[0].tolist():
                    found[doc] |= table.get(int(least[span][doc]), _NONE)
        return found

    def scan_texts(self, texts: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple[str, float]]]:
        """For each text (license, share of the template's shingles that it holds), the best of each license."""
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        rows, hashes = [], []
        for row, text in enumerate(texts):
            if words := license_words(text):
                rows.append(row)
                hashes.append(_hashes(words, self.shingle))
        if not rows or not self.spans:
            return out
        starts = np.cumsum([0, *map(len, hashes[:-1])])
        for row, h, found in zip(rows, hashes, self.candidates(np.concatenate(hashes), starts), strict=True):
            own = set(h.tolist()) if found else set()
            best: dict[str, float] = {}
            for t in found:
                share = len(self.shingles[t] & own) / len(self.shingles[t])
                if share >= threshold:
                    best[self.names[t]] = max(best.get(self.names[t], 0.0), share)
            out[row] = sorted(best.items())
        return out

    def scan(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, float]]:
        return self.scan_texts([text], threshold)[0]


_NONE: frozenset = frozenset()
_WORKER: dict[str, Index] = {}


def _index(name: str, templates: list[tuple[str, str]]) -> Index:
    """One index for each Python worker."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Index(templates)
    return _WORKER[name]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, containment of every license found in every row."""
    chosen = list(TEMPLATES) if templates is None else templates
    n = sum(len(license_words(t)) for _, t in chosen)
    if n > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {n} words; at most {MAX_TEMPLATE_WORDS} can be broadcast")
    import uuid

    sent, name = docs.sparkSession.sparkContext.broadcast(chosen), uuid.uuid4().hex

    def run(batches):
        index = _index(name, sent.value)
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, size = [], [], 0

            def scanned(ids: list, texts: list) -> list[tuple]:
                return [(d, license, share) for d, found in zip(ids, index.scan_texts(texts, threshold), strict=True) for license, share in found]

            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(d)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > CHUNK_CHARS:
                    rows += scanned(ids, texts)
                    ids, texts, size = [], [], 0
            rows += scanned(ids, texts)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "license", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, license string, containment double")
