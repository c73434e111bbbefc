"""Byte-level BPE as a streaming transducer, and its decoder.

Encoding keeps, for every byte position, the one token that ends the encoding of the text up
to there: of the vocabulary's tokens that end at the position, exactly one may follow the
encoding of what is before it, which pairs of neighbours decide. Any continuation of the text
extends the chain of one of the last ``lookahead`` positions, where ``lookahead``, computed from
the merge list, is the length of its longest product. So a token that the chains of all of
these positions share can't change any more: it is emitted and forgotten. State is the
positions since the last shared token.

Documents are fed in chunks of CHUNK characters. Chunks first pass a splitter into pretokens,
which holds back only what more input could still join or cut. A pretoken within the lookahead
has no stable token before its end, so it is encoded at its end, over the same positions in one
array, and its ids are kept in a cache of bounded size; a longer one is pushed through position
by position. Beside the ids of the row that is returned, memory doesn't grow with a text.

Decoding maps ids to bytes and bytes to text, CHUNK ids at a time, with an incremental UTF-8
state machine that replaces what is no UTF-8.

Defined results: a null text counts as empty and has no ids; special tokens in a text become
their ids, as the library does by default; rows with null or repeated ids are encoded like
any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Pretokens whose ids a worker keeps, of at most CACHED_CHARS characters.
CACHE = 700_000
CACHED_CHARS = 48
PAIRS = 1_000_000
#: A pretoken longer than this is passed on in parts.
HOLD = 1024
#: Characters of a text, and ids, that are taken at once.
CHUNK = 1 << 16

#: The pretokens of the byte-level vocabularies, and the contractions split off.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LITTLE = sys.byteorder == "little" and array("i").itemsize == 4
#: Below this character all Unicode versions in use agree on letters, numbers and spaces.
_NEWER = re.compile("[^\x00-՗]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.path = path
        self.ids = {to_bytes(t): i for t, i in data["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.ranks = {(self.ids[to_bytes(a)], self.ids[to_bytes(b)]): (r, self.ids[to_bytes(a + b)]) for r, (a, b) in enumerate(merges)}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.singles = [self.ids[bytes([b])] for b in range(256)]
        #: Bytes that an encoding may still depend on.
        self.lookahead = max(len(t) for t in self.ids)
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self._build_trie()
        self._pairs: dict[int, bool] = {}

    def _build_trie(self) -> None:
        nodes = 1
        for token, i in self.ids.items():
            if self.merge(token) != [i]:
                continue  # no encoding holds it
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.token_at[node] = i

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: the merge of least rank first, leftmost first. For short inputs."""
        parts, ranks = [self.singles[b] for b in data], self.ranks
        while len(parts) > 1:
            best = None
            for pair in zip(parts, parts[1:], strict=False):
                found = ranks.get(pair)
                if found is not None and (best is None or found < best):
                    best, at = found, pair
            if best is None:
                break
            out, k, n = [], 0, len(parts)
            while k < n:
                if k + 1 < n and parts[k] == at[0] and parts[k + 1] == at[1]:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        known = self._pairs.get(a << 20 | b)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            known = self._pairs[a << 20 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known


class Transducer:
    """Bytes of one pretoken in, stable ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        # For each position since the last emitted token: the token that ends there. Position 0 is the emitted one.
        self.last: deque = deque([None])
        self.active: list[tuple[int, int]] = []
        self.base = 0  # position number of last[0]

    def push(self, data: bytes) -> list[int]:
        v, trie, token_at, follow = self.v, self.v.trie, self.v.token_at, self.v.may_follow
        out: list[int] = []
        last = self.last
        for b in data:
            end = self.base + len(last)
            self.active.append((end - 1, 0))
            alive, found = [], None
            for start, node in self.active:
                node = trie.get(node << 8 | b)
                if node is None:
                    continue
                alive.append((start, node))
                token = token_at.get(node)
                if token is not None and found is None:
                    before = last[start - self.base]
                    if before is None or follow(before, token):
                        found = token
            self.active = alive
            last.append(found)
            if len(last) > 4 * v.lookahead:
                out += self._stable()
                last = self.last
        return out

    def short(self, data: bytes) -> list[int]:
        """All ids of a pretoken within the lookahead, where nothing is stable before its end: the same positions in one array."""
        v, n = self.v, len(data)
        trie, token_at, pairs, follow = v.trie, v.token_at, v._pairs, v.may_follow
        last, start_of = [None] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, node = last[start], 0
            for end in range(start, n):
                node = trie.get(node << 8 | data[end])
                if node is None:
                    break
                token = token_at.get(node)
                if token is not None and last[end + 1] is None:
                    if start:
                        known = pairs.get(before << 20 | token)
                        if known is None:
                            known = follow(before, token)
                        if not known:
                            continue
                    last[end + 1] = token
                    start_of[end + 1] = start
        ids = []
        while n:
            ids.append(last[n])
            n = start_of[n]
        ids.reverse()
        return ids

    def _chain(self, at: int) -> list[int]:
        """Positions of token ends from ``at`` back to the emitted one."""
        ends = []
        while at > self.base:
            ends.append(at)
            at -= len(self.v.bytes_of[self.last[at - self.base]])
        return ends

    def _stable(self) -> list[int]:
        top = self.base + len(self.last) - 1
        shared: set | None = None
        for at in range(max(self.base, top - self.v.lookahead + 1), top + 1):
            ends = set(self._chain(at))
            shared = ends if shared is None else shared & ends
            if not shared:
                return []
        upto = max(shared)
        ids = [self.last[e - self.base] for e in reversed(self._chain(upto))]
        for _ in range(upto - self.base):
            self.last.popleft()
        self.base = upto
        return ids

    def finish(self) -> list[int]:
        ids = [self.last[e - self.base] for e in reversed(self._chain(self.base + len(self.last) - 1))]
        self.reset()
        return ids


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes() if _LITTLE else np.asarray(ids, "<i4").tobytes()


class Encoder:
    """Text in, ids out, as little-endian bytes; feed() and finish() take a text in chunks, encode() a short one at once."""

    def __init__(self, path: str):
        import regex

        self.v = Vocabulary(path)
        self.transducer = Transducer(self.v)
        self.pattern = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, bytes] = {}
        self._library = None
        self._classes = [regex.compile(c) for c in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
        self._spaces = self._classes[-1]
        self._last_gap = regex.compile(r"(?r)(?<=\S)(?=\s)")
        self._run, self._held = None, ""
        self._keep = max(map(len, self.v.special), default=1)
        self._begun = {t[:k] for t in self.v.special for k in range(1, len(t))}

    def pretokens(self, text: str) -> list[str]:
        if not _NEWER.search(text):
            return self.pattern.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.v.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _one(self, pretoken: str) -> bytes:
        data = pretoken.encode("utf-8", "surrogatepass")
        if len(data) <= self.v.lookahead:
            ids = self.transducer.short(data)
        else:
            ids = self.transducer.push(data)
            ids += self.transducer.finish()
        return _packed(ids)

    def _plain(self, text: str) -> bytes:
        parts, cache = self.pretokens(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, parts))
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for p in parts:
            ids = cache.get(p)
            if ids is None:
                ids = self._one(p)
                if len(p) <= CACHED_CHARS and len(cache) <= CACHE:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.v.special or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.asarray([self.v.special[m[0]]], "<i4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def feed(self, chunk: str) -> bytes:
        """Ids that no further chunk can change. What is held back is short, however long the text or a pretoken is."""
        text, out = self._held + chunk if self._held else chunk, []
        # What may be the beginning of a special token waits.
        waits = next((k for k in range(min(self._keep - 1, len(text)), 0, -1) if text[-k:] in self._begun), 0)
        text, rest = text[: len(text) - waits], text[len(text) - waits :]
        while True:
            special = self.special.search(text)
            limit = special.start() if special else len(text)
            if self._run:
                end = m.end() if (m := self._run.match(text, 0, limit)) else 0
                goes_on = end == len(text)
                stop = end
                if goes_on:
                    stop = max(0, end - self._keep)
                elif self._run is self._spaces and end < limit:
                    stop = end - 1  # the last space belongs to what follows
                out.append(self._pushed(text[:stop]))
                text = text[stop:]
                if goes_on:
                    self._held = text + rest
                    return b"".join(out)
                out.append(_packed(self.transducer.finish()))
                self._run = None
                continue
            if not special:
                break
            out += [self._plain(text[:limit]), _packed([self.v.special[special[0]]])]
            text = text[special.end() :]
        # No pretoken spans the place between something visible and a space after it.
        m = self._last_gap.search(text)
        cut = m.start() if m else 0
        if cut:
            out.append(self._plain(text[:cut]))
            text = text[cut:]
        if len(text) > HOLD:
            parts = self.pretokens(text)
            if len(parts[-1]) > HOLD // 2:
                tail = parts.pop()
                out.append(self._plain("".join(parts)))
                self._run = next(c for c in self._classes if c.match(tail[-1]))
                stop = len(tail) - self._keep
                out.append(self._pushed(tail[:stop]))
                text = tail[stop:]
            else:
                back = 0
                while parts and back < self._keep:
                    back += len(parts.pop())
                back += len(parts.pop()) if parts else 0
                out.append(self._plain("".join(parts)))
                text = text[len(text) - back :]
        self._held = text + rest
        return b"".join(out)

    def _pushed(self, text: str) -> bytes:
        return _packed(self.transducer.push(text.encode("utf-8", "surrogatepass")))

    def finish(self) -> bytes:
        rest, self._held = self._held, ""
        if self._run:
            end = m.end() if (m := self._run.match(rest)) else 0
            if self._run is self._spaces and end < len(rest):
                end = max(0, end - 1)  # the last space belongs to what follows
            ids = self._pushed(rest[:end]) + _packed(self.transducer.finish())
            self._run = None
            return ids + self.encode(rest[end:])
        return self.encode(rest)

    def stream(self, text: str, chunk: int = CHUNK) -> bytes:
        """The ids of a whole text, fed in chunks."""
        return b"".join([*[self.feed(text[at : at + chunk]) for at in range(0, len(text), chunk)], self.finish()])


class Decoder:
    """Ids in, text out: a table from ids to bytes, then an incremental UTF-8 state machine."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text

    def decode(self, ids: np.ndarray) -> str:
        return "".join([*[self.feed(ids[at : at + CHUNK].tolist()) for at in range(0, len(ids), CHUNK)], self.finish()])


_WORKER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each Python worker: its vocabulary and cache serve later tasks too."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def _encode_batches(path: str):
    def run(batches):
        encoder = _encoder(path)
        decoder = Decoder(encoder.v)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [np.frombuffer(encoder.stream(t.as_py() or ""), "<i4") for t in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                text = pa.array([decoder.decode(x) for x in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, text], names=["doc_id", "ids", "decoded"])

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row."""
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return got.mapInArrow(released(_encode_batches(path or tokenizer_path())), "doc_id long, ids array<int>, decoded string")
