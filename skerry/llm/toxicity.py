"""Toxicity scores over deobfuscated text.

Words that look disguised (digits or signs among letters, letters doubled or drawn out, letters
set apart) are read through a noisy channel: a lattice of what each character may stand for, with
edges that drop separators and repetitions or take separators and spaces for word boundaries,
decoded by Viterbi under a character trigram model of the whole corpus, in time linear in the
length. The restored words are scored by a classifier over words and word beginnings, besides the
words as they stand.

Words cut into pieces ("st upid") are too like other text for the character model. So a second
lattice follows the words that count as signs, up to MAX_SPLIT letters, through the tokens, with
the same channel and spaces dropped; the pieces are read as one word where their shares of the
sample's clean documents make them unlikely (SPLIT_CHANCE) as words of their own.

The classifier is fitted on a bounded sample: of the labelled rows outside the held-out fold,
the MAX_TOXIC and MAX_CLEAN first ones by a hash of doc_id, of near copies about one each, so
that a text copied often doesn't make signs of its words. A feature counts if it is in so many
more toxic documents than chance explains (see :func:`choose_features`). The character model's
counts cover every document.

Defined results: a null or empty text has the score of a text without signs; rows with null or
repeated ids are scored by their text; labels that repeat a doc_id count as toxic if one is;
without labels (or toxic ones) every score is BASE; an empty table gives an empty result;
further columns are kept by :func:`filter_documents` and ignored by :func:`score_documents`.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, released, scratch

#: Bounds of the sample of labelled rows that the classifier is fitted on.
MAX_TOXIC, MAX_CLEAN = 4_000, 12_000
PREFIXES = (3, 4, 5, 6)
LEAST_LETTERS = 3
#: Expected number of features that chance lets through.
CHANCE = 5.0
LEAST_LOG_ODDS = 1.5
THRESHOLD = 0.3
#: The score of a text where no classifier could be fitted.
BASE = 0.02
FOLD = 2
#: Minima by which near copies in the sample are told.
COPY_KEYS = 4
#: Words whose weights a worker keeps.
CACHE = 120_000
#: Characters of texts that are counted at once.
CHUNK_CHARS = 1_000_000
MAX_SPLIT = 40
SPLIT_CHANCE = 1e-4

#: What characters may stand for, besides themselves.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Letters of other scripts and widths that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t",
    "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
} | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)}
LOOKALIKES |= HOMOGLYPHS
_SEPARATORS = set(".-_*~'`^,:;/\\=#%&\"")
_SIZE = 96


def _alphabet() -> np.ndarray:
    """Class of each character below U+0250: 0 is no letter; letters count in lower case, rare ones share the last class."""
    table, at = np.zeros(0x250, np.int64), {}
    for cp in range(0x250):
        low = chr(cp).lower()
        if low.isalpha() and len(low) == 1:
            at.setdefault(low, min(len(at) + 1, _SIZE - 1))
            table[cp] = at[low]
    return table


_CLASS = _alphabet()


def char_class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 0x250 else 0


def _chunks(texts):
    """Lists of texts of about CHUNK_CHARS characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _trigram_batches(batches):
    total = np.zeros(_SIZE**3, np.int64)

    def count(texts: list[str]) -> None:
        cps = np.frombuffer("\0\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = _CLASS[np.where(cps < 0x250, cps, 0)]
        where, n = np.unique((codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:], return_counts=True)
        total[where] += n

    for batch in batches:
        for part in _chunks(t.as_py() or "" for t in batch.column(0)):
            count(part)
    where = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["code", "n"])


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over every text; at most _SIZE cubed of them, whatever the input."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(released(_trigram_batches), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(_SIZE**3)
    total[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return total


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), each order backed by the next lower one."""
    tri = counts.reshape(_SIZE, _SIZE, _SIZE)
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0)
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * _SIZE)
    p2 = (bi + 8 * p1) / (bi.sum(axis=1, keepdims=True) + 8)
    p3 = (tri + 8 * p2) / (tri.sum(axis=2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


def _edges(word: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may have been ('' if it was put in, a space for a word boundary) and the log probability of the channel."""
    out = []
    for i, c in enumerate(word):
        options: list[tuple[str, float]] = []
        if c.isspace():
            options += [("", -0.5), (" ", -0.3)]
        elif c.isalpha():
            options.append((c, -0.1))
            options += [(x, -0.7) for x in LOOKALIKES.get(c, "")]
            if i and word[i - 1] == c:
                options.append(("", -0.7))
        else:
            options += [(x, -1.0) for x in LOOKALIKES.get(c, "")]
            if c in _SEPARATORS or not c.isalnum():
                options += [("", -1.5), (" ", -2.0)]
            if i and word[i - 1] == c:
                options.append(("", -0.7))
            options.append((c, -4.0))
        out.append(options)
    return out


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest words behind a disguised run: Viterbi over the lattice; states are the last two classes."""
    logs = memoryview(np.ascontiguousarray(model).reshape(-1))
    # Texts are chains (before, character), so that a step costs the same at any length.
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in _edges(word):
        after: dict[int, tuple[float, tuple | None]] = {}
        steps = [(char, cost, char_class(char) if char else -1) for char, cost in options]
        for key, (value, chain) in states.items():
            for char, cost, k in steps:
                if k < 0 or (char == " " and key % _SIZE == 0):
                    to, v, char = key, value + cost, ""
                else:
                    to, v = key % _SIZE * _SIZE + k, value + cost + logs[key * _SIZE + k]
                if to not in after or after[to][0] < v:
                    after[to] = (v, (chain, char) if char else chain)
        states = after
    chain = max(states.items(), key=lambda x: x[1][0] + (logs[x[0] * _SIZE] if x[0] % _SIZE else 0.0))[1][1]
    out = []
    while chain:
        chain, char = chain
        out.append(char)
    return "".join(reversed(out))


#: Letters set apart, by one or more separators each.
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.\-_*]+[^\W_@$!](?![^\s.\-_*])){3,}(?!\S)|(?<!\S)[^\W\d_](?:[\s.\-_*]+[\w@$!](?![^\s.\-_*])){3,}(?!\S)")
_GAPS = re.compile(r"[\s.\-_*]+")
_TRAIL = re.compile(r"([%&#*$!|?.<>])\1{1,}[.,]?$")
_DISGUISED = re.compile("[" + "".join(HOMOGLYPHS) + r"]|[^\W\d_][0-9@$!|+(€£¡]+[^\W\d_]|[0-9@$!|+(€£¡]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$€£¡]+|([^\W\d_])\1|[^\W\d_][.\-_*~'`^,:;/\\=#%&\"]+[^\W\d_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Signs that end words and stand for nothing else.
_PLAIN = ".,;:?\"'"
_DOUBLED = re.compile(r"(.)\1")
#: Letters of Latin-1 twice, for an engine without back references.
_TWINS = "|".join(chr(c) * 2 for c in range(0x100) if chr(c).isalpha() and chr(c).lower() == chr(c))


def restore_word(word: str, model: np.ndarray) -> str:
    """A word in lower case, without what surrounds it, and read through the channel if it looks disguised; it may turn out to be several."""
    low = _TRAIL.sub("", word.lower())
    if _DISGUISED.search(low):
        low = " ".join(_EDGES.sub("", x) for x in decode(low, model).split())
    return _EDGES.sub("", low)


def restore_run(run: str, model: np.ndarray) -> str:
    """The words behind letters set apart."""
    return decode(_GAPS.sub(" ", run.lower()), model)


def restore(text: str, model: np.ndarray) -> str:
    """The text with letters set apart joined to words and disguised words restored; words are joined by one space."""
    joined = _SPACED.sub(lambda m: restore_run(m[0], model), text)
    return " ".join(w for w in (restore_word(x, model) for x in joined.split()) if w)


def readings(word: str, model: np.ndarray) -> set[str]:
    """The word as it stands, and the words that the channel makes of it."""
    return {_EDGES.sub("", _TRAIL.sub("", word.lower())), *restore_word(word, model).split()}


def word_features(word: str, model: np.ndarray) -> list[str]:
    return list({f for w in readings(word, model) for f in features(w)})


def features(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) > k]] if len(word) >= LEAST_LETTERS else []


class Scorer:
    """Measures and scores texts, with a bounded cache of what is known of words.

    ``weights``: log odds of features; ``final``: slopes of the measures, the constant, and
    the measures' least and largest values in the sample (none: no score); ``pieces``: the share
    of clean documents that hold a piece of a sign as a word of its own, and at '' any other's.
    """

    def __init__(self, model: np.ndarray, weights: dict[str, float], final: tuple | None = None, pieces: dict[str, float] | None = None):
        self.model, self.weights, self.final, self.pieces = model, weights, final, pieces or {}
        self.cache: dict[str, tuple] = {}
        self.signs = whole_signs(weights) if pieces else set()
        self.beginnings = {w[:k] for w in self.signs for k in range(1, len(w) + 1)}
        #: The first letters that any feature has.
        self.heads = {f[:LEAST_LETTERS] for f in weights}
        self.ends = {f.removesuffix("$") for f in weights}
        self.toward = {f[:k] for f in self.ends for k in range(1, len(f) + 1)}
        self._starts = pa.array(sorted(self.heads | {b[:LEAST_LETTERS] for b in self.beginnings}), pa.string())

    def telling(self, words: list[str]) -> list[str]:
        """The words that may have a weight or begin a sign: all but those of Latin-1 letters whose readings all begin alike, and as no feature or sign does."""
        given = pa.array(words, pa.string())
        core = pc.utf8_rtrim(pc.utf8_lower(given), _PLAIN)
        head = pc.utf8_slice_codeunits(core, 0, LEAST_LETTERS)
        kept = pc.or_(pc.invert(pc.utf8_is_alpha(core)), pc.is_in(head, value_set=self._starts))
        kept = pc.or_(kept, pc.or_(pc.match_substring_regex(head, _TWINS), pc.match_substring_regex(core, r"[^\x{00}-\x{ff}]")))
        return given.filter(kept).to_pylist()

    def reaches(self, low: str) -> bool:
        """Whether any path of the lattice has a feature with a weight; if not, decoding can't change the weight."""
        nodes, last = {""}, ""
        for c in low:
            after = {p + x for p in nodes for x in (c, *LOOKALIKES.get(c, "")) if p + x in self.toward}
            if not after.isdisjoint(self.ends):
                return True
            if c == last or not c.isalnum():
                after |= nodes
            if not c.isalnum():
                after.add("")
            if not after:
                return False
            nodes, last = after, c
        return False

    def weight(self, word: str) -> float:
        low = _TRAIL.sub("", word.lower())
        fs = features(_EDGES.sub("", low)) if not (_DISGUISED.search(low) and self.reaches(low)) else word_features(word, self.model)
        return max((self.weights[f] for f in fs if f in self.weights), default=0.0)

    def known(self, word: str) -> tuple:
        """Of a word: its weight, the beginnings of signs that it may be (or None), its share if it may be one, and its letters if the lattice has one path."""
        core = word.lower().rstrip(_PLAIN)
        if core.isalpha() and (core.isascii() or HOMOGLYPHS.keys().isdisjoint(core)):
            doubled = _DOUBLED.search(core)
            if not doubled:  # nothing to decode
                weights = self.weights
                best = max((weights[f] for f in features(core) if f in weights), default=0.0) if core[:LEAST_LETTERS] in self.heads else 0.0
                return (best, {core}, self.share(word), core) if core in self.beginnings else (best, None, 1.0, core) if best else (0.0, None, 1.0, core)
            if doubled.start() >= LEAST_LETTERS - 1:  # all readings begin alike
                best = self.weight(word) if core[:LEAST_LETTERS] in self.heads else 0.0
                nodes = self.walk({""}, word) if core[:LEAST_LETTERS] in self.beginnings else None
                return (best, nodes, self.share(word), None) if nodes else (best, None, 1.0, None)
        best, two = self.weight(word), core[:2]
        plain = len(two) == 2 and two[0] != two[1] and two.isalpha() and two.isascii()
        nodes = self.walk({""}, word) if self.signs and not (plain and two not in self.beginnings) else None
        return (best, nodes, self.share(word), None) if nodes else (best, None, 1.0, None)

    def words(self, text: str) -> set[str]:
        own = set(text.split())
        for m in _SPACED.finditer(text):
            own.add(_GAPS.sub("", m[0]))
            own.update(restore_run(m[0], self.model).split())
        return own

    def walk(self, nodes: set[str], token: str) -> set[str]:
        """The beginnings of signs that those of ``nodes`` become by a token."""
        for c in token.lower():
            after = set()
            for p in nodes:
                after.update(p + x for x in (c, *LOOKALIKES.get(c, "")) if p + x in self.beginnings)
                if not c.isalnum() or p[-1:] == c:
                    after.add(p)
            nodes = after
            if not nodes:
                break
        return nodes - {""}

    def split_signs(self, tokens: list[str], known: dict[str, tuple]) -> set[str]:
        """The signs that lie in pieces over two or more tokens, and are unlikely as words of their own.

        ``known``: what :meth:`known` says of the telling ones. Linear in the tokens: paths that meet in one beginning go on as one.
        """
        found: set[str] = set()
        active: dict[str, float] = {}  # beginnings of signs that end with the last token, and the least chance of their pieces
        for token in tokens:
            got = known.get(token)
            if got is None:
                if not active:
                    continue
                core = token.lower().rstrip(_PLAIN)
                begin, own, plain = None, 1.0, None if _DOUBLED.search(core) else core
            else:
                _, begin, own, plain = got
                if not active and not begin:
                    continue
            after: dict[str, float] = {}
            for p, chance in active.items():
                if plain is not None and p[-1] != plain[0]:
                    nodes = (p + plain,) if p + plain in self.beginnings else ()
                elif token[0].isalpha() and token[0].isascii() and (x := token[0].lower()) != p[-1] and p + x not in self.beginnings:
                    nodes = ()
                else:
                    nodes = self.walk({p}, token)
                for q in nodes:
                    c = chance * self.share(token)
                    if c < after.get(q, 2.0):
                        after[q] = c
                        if c < SPLIT_CHANCE and q in self.signs:
                            found.add(q)
            for q in begin or ():
                after[q] = min(own, after.get(q, 2.0))
            active = after
        return found

    def share(self, token: str) -> float:
        piece = _EDGES.sub("", token.lower())
        return self.pieces.get(piece, self.pieces[""]) if piece else 1.0

    def measures_of(self, texts: list[str]) -> list[list[float]]:
        """Of each text's distinct words: the largest weight, the logarithms of the sum of weights and of how many have one,
        their number by the square root of all, and the logarithm of all."""
        cache, words = self.cache, [self.words(t) for t in texts]
        known: dict[str, tuple] = {}
        for w in self.telling(list(set().union(*words))) if words else ():
            got = cache.get(w)
            if got is None:
                got = self.known(w)
                if len(cache) > CACHE:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = got
            if got[0] or got[1] or got[3] is None:
                known[w] = got
        out = []
        for text, own in zip(texts, words, strict=True):
            mine = [known[w] for w in own if w in known]
            signs = [got[0] for got in mine if got[0]]
            if any(got[1] for got in mine):
                signs += [self.weights[w + "$"] for w in self.split_signs(text.split(), known)]
            n = len(own) + 1
            out.append([max(signs, default=0.0), math.log1p(math.fsum(signs)), math.log1p(len(signs)), len(signs) / math.sqrt(n), math.log(n)])
        return out

    def measures(self, text: str | None) -> list[float]:
        return self.measures_of([text or ""])[0]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.final:
            return [BASE] * len(texts)
        slopes, constant, low, high = self.final
        out = []
        for part in _chunks([t or "" for t in texts]):
            for measures in self.measures_of(part):
                # Measures beyond those of the sample count as its extremes.
                total = constant + math.fsum(a * min(max(x, lo), hi) for a, x, lo, hi in zip(slopes, measures, low, high, strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(total, 30.0)))))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple:
    """Slopes and constant by Newton's method on standardised columns, with the columns' ranges."""
    mean = x.mean(axis=0)
    scale = np.maximum(x.std(axis=0), 0.02 * np.abs(mean) + 1e-6)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, keep = np.zeros(z.shape[1]), ridge * np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    slope = w[:-1] / scale
    return slope.tolist(), float(w[-1] - (slope * mean).sum()), x.min(axis=0).tolist(), x.max(axis=0).tolist()


def whole_signs(weights: dict[str, float]) -> set[str]:
    """The words that count as signs and are followed through pieces."""
    return {f[:-1] for f, v in weights.items() if f.endswith("$") and v > 0 and 3 < len(f) - 1 <= MAX_SPLIT}


def _pieces_batches(wanted):
    """(text) -> documents that hold each of the pieces ``wanted`` as a word of its own."""

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                count.update(wanted.value & {_EDGES.sub("", w) for w in (text.as_py() or "").lower().split()})
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])

    return run


_WORKER: dict[str, Scorer] = {}


def _scorer(sent) -> Scorer:
    model, weights, final, pieces, name = sent.value
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Scorer(model, weights, final, pieces)
    return _WORKER[name]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def _counted(sent_model, only):
    """(toxic, text) -> documents of each class that hold each feature (of ``only``, if given)."""

    def run(batches):
        wanted = only.value if only is not None else None
        scorer = Scorer(sent_model.value, dict.fromkeys(wanted or (), 1.0))
        count: Counter = Counter()
        known: dict[str, list[str]] = {}
        for batch in batches:
            for text in batch.column(0):
                own: set[str] = set()
                for w in scorer.words(text.as_py() or ""):
                    fs = known.get(w)
                    if fs is None:
                        # Where only some features count, decoding is left out for words that reach none of them.
                        fs = word_features(w, scorer.model) if wanted is None or scorer.weight(w) else []
                        if wanted is not None:
                            fs = [f for f in fs if f in wanted]
                        if len(known) > CACHE:
                            known.clear()
                        known[w] = fs
                    own.update(fs)
                count.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["feature", "n"])

    return run


def _copy_keys(batches):
    """(doc_id, toxic, text) -> COPY_KEYS minima over the text's 3-word shingles."""
    import xxhash

    flips = np.random.default_rng(FOLD).integers(0, 1 << 63, (COPY_KEYS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        keys = []
        for text in batch.column(2):
            words = text.as_py().lower().split()
            n = max(1, len(words) - 2)
            low = np.full(COPY_KEYS, ~np.uint64(0))
            for at in range(0, n, 1 << 14):
                h = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(at, min(n, at + (1 << 14)))), np.uint64)
                low = np.minimum(low, ((h ^ (h >> np.uint64(29))) * flips).min(axis=1))
            keys.append(low.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "toxic", "keys"])


def without_copies(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """Of documents (doc_id, toxic, keys), one for each key and class, key by key: of a group of near copies hardly more than one is left."""
    rows = sorted(rows)
    for k in range(COPY_KEYS):
        first: dict[tuple[int, int], tuple] = {}
        for r in rows:
            first.setdefault((r[1], r[2][k]), r)
        rows = list(first.values())
    return [r[0] for r in rows]


def log_odds(t: float, c: float, n_toxic: int, n_clean: int) -> float:
    return math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))


def choose_features(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, tuple[int, int]]:
    """Counts of features whose share of toxic documents chance doesn't explain.

    With C = 0 clean documents, T toxic ones happen by chance with probability q^T for the toxic
    share q of the sample; with others, the excess over q T is judged by its binomial tail bound.
    """
    q = n_toxic / max(1, n_toxic + n_clean)
    out = {}
    for f, t in toxic.items():
        c = clean.get(f, 0)
        p = t / (t + c)
        if t < 3 or p <= q:
            continue
        bound = t * math.log(p / q) + (c * math.log((1 - p) / (1 - q)) if c else 0.0)  # n times the divergence
        if bound >= math.log(max(len(toxic), 1) / CHANCE) and log_odds(t, c, n_toxic, n_clean) >= LEAST_LOG_ODDS:
            out[f] = (t, c)
    return out


def _measured(sent):
    """(toxic, text) -> toxic and the text's measures, with the weights as they are without this text."""

    def run(batches):
        model, weights, pieces = sent.value
        scorers = {k: Scorer(model, weights[k], None, pieces) for k in (0, 1)}
        for batch in batches:
            rows = []
            for k, scorer in scorers.items():
                for part in _chunks(t.as_py() or "" for of, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if of == k):
                    rows += [[float(k), *m] for m in scorer.measures_of(part)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["row"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], tuple | None, dict[str, float]]:
    """The character model of all documents, the classifier's weights, its final coefficients, and the shares of pieces."""
    spark = docs.sparkSession
    model = char_model(char_counts(docs))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    each = materialize(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))  # one text for each id of the sample
    keyed = each.mapInArrow(released(_copy_keys), "doc_id long, toxic int, keys array<long>").collect()  # a row for each id of the sample
    once = spark.createDataFrame([(i,) for i in without_copies([tuple(r) for r in keyed])], "doc_id long")
    texts = materialize(each.join(F.broadcast(once), "doc_id"))
    sent = spark.sparkContext.broadcast(model)
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def count(rows: DataFrame, only=None) -> DataFrame:
        return rows.select("text").mapInArrow(released(_counted(sent, only)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    found = count(texts.where("toxic = 1")).where("n >= 3")
    toxic = {r["feature"]: r["n"] for r in found.collect()}
    if not toxic:
        return model, {}, None, {}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {r["feature"]: r["n"] for r in count(texts.where("toxic = 0"), wanted).collect()}
    chosen = choose_features(toxic, clean, n_toxic, n_clean)
    weights = {f: log_odds(t, c, n_toxic, n_clean) for f, (t, c) in chosen.items()}
    signs = whole_signs(weights)
    parts = spark.sparkContext.broadcast({w[i:k] for w in signs for i in range(len(w)) for k in range(i + 1, len(w) + 1)})
    held = texts.where("toxic = 0").select("text").mapInArrow(released(_pieces_batches(parts)), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    pieces = {"": 0.5 / (n_clean + 1)} | {r["piece"]: (r["n"] + 0.5) / (n_clean + 1) for r in held}
    # Each text of the sample is measured with weights that leave it out.
    without = {1: {f: max(0.0, log_odds(t - 1, c, n_toxic, n_clean)) for f, (t, c) in chosen.items()}, 0: {f: log_odds(t, max(0, c - 1), n_toxic, n_clean) for f, (t, c) in chosen.items()}}
    sent = spark.sparkContext.broadcast((model, without, pieces))
    rows = np.array([r[0] for r in texts.select("toxic", "text").mapInArrow(released(_measured(sent)), "row array<double>").collect()])
    # In one order, whatever order tasks end in: sums of floats, and so scores, don't depend on the cluster's layout.
    rows = rows[np.lexsort(rows.T)]
    return model, weights, logistic(rows[:, 1:], rows[:, 0]), pieces


def score_column(docs: DataFrame, text: Column, fitted: tuple) -> Column:
    """The score of a text column under a fitted model, which is broadcast (its size is bounded)."""
    import uuid

    sent = docs.sparkSession.sparkContext.broadcast((*fitted, uuid.uuid4().hex))

    @F.pandas_udf(T.DoubleType())
    def score(texts):
        import pandas as pd

        scorer = _scorer(sent)
        return pd.Series(scorer.scores(list(texts)), dtype="float64")

    return score(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    with scratch():
        fitted = fit(docs, labels)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, F.col("text"), fitted).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their columns."""
    with scratch():
        fitted = fit(docs, labels)
    name = "_skerry_toxicity"
    return docs.withColumn(name, score_column(docs, docs["text"], fitted)).where(F.col(name) < THRESHOLD).drop(name)
