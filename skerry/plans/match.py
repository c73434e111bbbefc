"""The match language: lexer, parser, and compilation to one predicate (FTS-1..FTS-18).

Grammar, tightest first: phrase (words joined by +, * for a prefix, ^ for the first token,
NEAR(...)), column filter, phrases side by side (all must match), NOT, AND, OR, parentheses.
Operators are upper case. Parentheses take no neighbour without an operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


class QuerySyntaxError(ValueError):
    """The query isn't a sentence of the match language."""


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


@dataclass(frozen=True)
class Field:
    """A condition on metadata (FTS-18): name and words of the value."""

    name: str
    value: str


_TOKEN = None


def split_words(text: str) -> tuple[str, ...]:
    global _TOKEN
    if _TOKEN is None:
        import regex

        _TOKEN = regex.compile(T.TOKEN)
    return tuple(_TOKEN.findall(T.fold_py(text)))


def lex(query: str) -> list[tuple[str, str]]:
    out, i, n = [], 0, len(query)
    while i < n:
        c = query[i]
        if c in " \t\n\r":
            i += 1
        elif c in "(){}:+*^,-":
            out.append((c, c))
            i += 1
        elif c == '"':
            j, text = i + 1, ""
            while True:
                k = query.find('"', j)
                if k < 0:
                    raise QuerySyntaxError("unterminated string")
                text += query[j:k]
                if query[k + 1 : k + 2] == '"':
                    text += '"'
                    j = k + 2
                    continue
                break
            out.append(("string", text))
            i = k + 1
        elif c.isascii() and (c.isalnum() or c == "_") or not c.isascii() or c == "\x1a":
            j = i
            while j < n and (query[j] == "_" or query[j] == "\x1a" or not query[j].isascii() or query[j].isalnum()):
                j += 1
            word = query[i:j]
            out.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
            i = j
        else:
            raise QuerySyntaxError(f"syntax error near {c!r}")
    return out


@dataclass
class Parser:
    """``columns``: name -> whether it is indexed; ``fields``: metadata names that may be asked for (none: an error).

    ``lenient`` takes AND NOT for NOT.
    """

    tokens: list[tuple[str, str]]
    columns: dict[str, bool] = field(default_factory=lambda: {"path": False, "chunk_text": True})
    fields: frozenset = frozenset()
    lenient: bool = False
    at: int = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise QuerySyntaxError(f"{kind} expected at {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise QuerySyntaxError(f"syntax error near {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        parts = [self.both()]
        while self.peek() == "OR":
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    def both(self):
        node = self.without()
        while self.peek() == "AND":
            self.at += 1
            if self.lenient and self.peek() == "NOT":
                self.at += 1
                node = Without(node, self.without())
            else:
                node = All((node, self.without()))
        return node

    def without(self):
        node = self.primary()
        while self.peek() == "NOT":
            self.at += 1
            node = Without(node, self.primary())
        return node

    def primary(self):
        if self.peek() == "(":
            self.at += 1
            node = self.either()
            self.take(")")
            return node
        columns = self.column_filter()
        if columns is not None and self.peek() == "(":
            self.at += 1
            node = self.either()
            self.take(")")
            return node if columns else Nothing()
        parts = [self.near_set(columns)]
        while self.peek() in ("word", "string", "^", "{", "-"):
            parts.append(self.near_set(self.column_filter()))
        real = [p for p in parts if not (isinstance(p, Phrase) and not p.tokens)]
        if not real:
            return Nothing()
        return real[0] if len(real) == 1 else All(tuple(real))

    def column_filter(self):
        """None: no filter; a Field; else whether an indexed column is meant."""
        start, negated = self.at, False
        if self.peek() == "-":
            negated = True
            self.at += 1
        if self.peek() == "{":
            self.at += 1
            names = []
            while self.peek() in ("word", "string"):
                names.append(self.tokens[self.at][1])
                self.at += 1
            self.take("}")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names = [self.tokens[self.at][1]]
            self.at += 1
        elif negated:
            raise QuerySyntaxError("syntax error near '-'")
        else:
            self.at = start
            return None
        self.take(":")
        if len(names) == 1 and not negated and names[0].lower() in self.fields:
            return Field(names[0].lower(), "")
        chosen = set()
        for name in names:
            if name.lower() not in self.columns:
                raise QuerySyntaxError(f"no such column: {name}")
            chosen.add(name.lower())
        chosen = set(self.columns) - chosen if negated else chosen
        return any(self.columns[c] for c in chosen)

    def near_set(self, columns):
        if isinstance(columns, Field):
            if self.peek() not in ("word", "string"):
                raise QuerySyntaxError("a value must follow the field")
            return Field(columns.name, self.take(self.peek()))
        if self.peek() == "^":
            self.at += 1
            node = self.phrase(initial=True)
        elif self.peek() == "word" and self.peek(1) == "(":
            if self.take("word") != "NEAR":
                raise QuerySyntaxError("syntax error near '('")
            self.take("(")
            phrases = [self.phrase()]
            while self.peek() in ("word", "string"):
                phrases.append(self.phrase())
            distance = 10
            if self.peek() == ",":
                self.at += 1
                word = self.take("word")
                if not (word.isascii() and word.isdigit()):
                    raise QuerySyntaxError(f"expected integer, got {word!r}")
                distance = int(word)
            self.take(")")
            real = tuple(p for p in phrases if p.tokens)
            node = Near(real, distance) if len(real) > 1 else (real[0] if real else Phrase(()))
        else:
            node = self.phrase()
        return Nothing() if columns is False else node

    def phrase(self, initial: bool = False) -> Phrase:
        tokens, prefix = (), False
        while True:
            if self.peek() not in ("word", "string"):
                raise QuerySyntaxError("syntax error: a word or string is expected")
            kind, text = self.tokens[self.at]
            self.at += 1
            tokens += split_words(text)
            if self.peek() == "*":
                self.at += 1
                prefix = True
            if self.peek() != "+":
                return Phrase(tokens, prefix, initial)
            self.at += 1


def parse(query: str, *, lenient: bool = False, fields: frozenset = frozenset(), columns: dict[str, bool] | None = None):
    parser = Parser(lex(query), lenient=lenient, fields=fields)
    if columns is not None:
        parser.columns = columns
    return parser.whole()


def phrases_of(node) -> list[Phrase]:
    """Phrases that a hit shows, in order of the query; those after NOT aren't among them."""
    if isinstance(node, Phrase):
        return [node] if node.tokens else []
    if isinstance(node, Near):
        return list(node.phrases)
    if isinstance(node, All | Any):
        return [p for part in node.parts for p in phrases_of(part)]
    if isinstance(node, Without):
        return phrases_of(node.keep)
    return []


def leaves_of(node) -> list:
    """The phrases, NEAR groups and fields of a query."""
    if isinstance(node, Without):
        return leaves_of(node.keep) + leaves_of(node.drop)
    return [x for part in node.parts for x in leaves_of(part)] if isinstance(node, All | Any) else [node]


def terms_of(node) -> list[str]:
    return list(dict.fromkeys(t for p in phrases_of(node) for t in p.tokens))


def joined(tokens: Column) -> Column:
    """The tokens between single spaces: what compiled phrases search, in generated code."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _starts(tokens: Column, p: Phrase) -> Column:
    n = len(p.tokens)

    def here(i: Column) -> Column:
        same = [F.get(tokens, i + k) == F.lit(t) for k, t in enumerate(p.tokens)]
        if p.prefix:
            same[-1] = F.startswith(F.get(tokens, i + n - 1), F.lit(p.tokens[-1]))
        return reduce(lambda a, b: a & b, same)

    found = F.filter(F.sequence(F.lit(0), F.size(tokens) - n), here)
    if p.initial:
        found = F.filter(found, lambda i: i == 0)
    return F.when(F.size(tokens) >= n, found).otherwise(F.array().cast("array<int>"))


def compile_match(node, tokens: Column, text: Column | None = None, metadata: dict[str, Column] | None = None) -> Column:
    """One boolean column. ``tokens``: array of folded tokens; ``text``: joined(tokens), if it is at hand.

    The tokens and their joined text are bound once a row, however many phrases ask for them.
    """
    if text is None:
        kinds = [isinstance(x, Near) for x in leaves_of(node)]
        if len(kinds) == 1:
            return compile_match(node, tokens, joined(tokens), metadata)
        if not any(kinds):
            return T.let(joined(tokens), lambda s: compile_match(node, tokens, s, metadata))
        return T.let(tokens, lambda tk: T.let(joined(tk), lambda s: compile_match(node, tk, s, metadata)))
    s = text
    go = lambda x: compile_match(x, tokens, s, metadata)
    if isinstance(node, Nothing):
        return F.lit(False)
    if isinstance(node, Field):
        column = (metadata or {}).get(node.name)
        if column is None:
            raise QuerySyntaxError(f"no such field: {node.name}")
        return F.coalesce(F.contains(T.fold(column.cast("string")), F.lit(T.fold_py(node.value))), F.lit(False))
    if isinstance(node, Phrase):
        if not node.tokens:
            return F.lit(False)
        wanted = F.lit(" " + " ".join(node.tokens) + ("" if node.prefix else " "))
        return F.startswith(s, wanted) if node.initial else F.contains(s, wanted)
    if isinstance(node, Near):
        return T.let(tokens, lambda tk: _near(tk, node))
    if isinstance(node, Without):
        return go(node.keep) & ~go(node.drop)
    parts = [go(p) for p in node.parts]
    return reduce((lambda a, b: a & b) if isinstance(node, All) else (lambda a, b: a | b), parts)


def _near(tokens: Column, node: Near) -> Column:
    """Whether starts of all phrases lie so close that at most ``distance`` tokens are between each one's end and the last start."""

    return T.let(F.array(*[_starts(tokens, p) for p in node.phrases]), lambda places: _close_places(places, node))


def _close_places(places: Column, node: Near) -> Column:
    each = [F.get(places, F.lit(i)) for i in range(len(node.phrases))]

    def close(m: Column) -> Column:
        return reduce(lambda a, b: a & b, [_within(at, m, len(p.tokens), node.distance) for at, p in zip(each, node.phrases, strict=True)])

    return F.exists(F.flatten(places), close)


def compile_places(node, places) -> Column:
    """The same predicate over posting lists: ``places(token, prefix)`` is the sorted positions of a token (or of a prefix' tokens) in the row."""

    def starts(p: Phrase) -> Column:
        own = [places(t, p.prefix and k == len(p.tokens) - 1) for k, t in enumerate(p.tokens)]
        found = own[0] if len(own) == 1 else F.filter(own[0], lambda s: reduce(lambda a, b: a & b, [F.array_contains(o, s + k) for k, o in enumerate(own) if k]))
        return F.filter(found, lambda s: s == 0) if p.initial else found

    go = lambda x: compile_places(x, places)
    if isinstance(node, Nothing) or isinstance(node, Phrase) and not node.tokens:
        return F.lit(False)
    if isinstance(node, Field):
        raise QuerySyntaxError(f"no such field: {node.name}")
    if isinstance(node, Phrase):
        return F.size(starts(node)) > 0
    if isinstance(node, Near):
        return T.let(F.array(*map(starts, node.phrases)), lambda found: _close_places(found, node))
    if isinstance(node, Without):
        return go(node.keep) & ~go(node.drop)
    return reduce((lambda a, b: a & b) if isinstance(node, All) else (lambda a, b: a | b), map(go, node.parts))


def needed(node) -> set[str]:
    """Whole tokens that every hit holds."""
    if isinstance(node, Phrase):
        return set(node.tokens[:-1] if node.prefix else node.tokens)
    if isinstance(node, Near):
        return set().union(*map(needed, node.phrases))
    if isinstance(node, Without):
        return needed(node.keep)
    if isinstance(node, All):
        return set().union(*map(needed, node.parts))
    return set.intersection(*map(needed, node.parts)) if isinstance(node, Any) else set()


def _within(places: Column, m: Column, n: int, distance: int) -> Column:
    return F.exists(places, lambda x: (x <= m) & (m - x - n <= distance))


def snippet(text: Column, node, before: str = "...", after: str = "...", ellipsis: str = "...", width: int = 64) -> Column:
    """The text with every instance of the query's phrases marked; overlapping ones share a mark. Texts over ``width`` tokens
    are cut to the window with the most instances, the first of those."""
    from pyspark.sql import types as types

    wanted = [(p.tokens, p.prefix, p.initial) for p in phrases_of(node)]

    @F.pandas_udf(types.StringType())
    def mark(texts):
        import pandas as pd

        return pd.Series([None if t is None else snippet_of(t, wanted, before, after, ellipsis, width) for t in texts])

    return mark(text)


def snippet_of(text: str, wanted: list, before: str, after: str, ellipsis: str, width: int) -> str:
    import regex

    spans = [m.span() for m in regex.finditer(T.TOKEN, text)]
    folded = [T.fold_py(text[a:b]) for a, b in spans]
    hits: list[list[int]] = []
    for tokens, prefix, initial in wanted:
        n = len(tokens)
        for i in range(1 if initial else len(folded) - n + 1) if len(folded) >= n else ():
            part = folded[i : i + n]
            if part[:-1] == list(tokens[:-1]) and (part[-1].startswith(tokens[-1]) if prefix else part[-1] == tokens[-1]):
                hits.append([i, i + n])
    hits.sort()
    merged: list[list[int]] = []
    for a, b in hits:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    lo, hi = 0, len(spans)
    if len(spans) > width:
        starts = sorted({max(0, min(a, len(spans) - width)) for a, _ in merged} | {0})
        lo = max(starts, key=lambda s: (sum(s <= a and b <= s + width for a, b in merged), -s))
        hi = lo + width
    out, at = [ellipsis if lo else ""], 0 if not lo else spans[lo][0]
    for a, b in merged:
        if lo <= a and b <= hi:
            out += [text[at : spans[a][0]], before, text[spans[a][0] : spans[b - 1][1]], after]
            at = spans[b - 1][1]
    end = len(text) if hi >= len(spans) else spans[hi - 1][1]
    return "".join([*out, text[at:end], ellipsis if hi < len(spans) else ""])


def from_signs(query: str) -> str:
    """``+must -not plain`` written in the match language (FTS-17): must parts together, without the others."""
    import re

    must, other, no = [], [], []
    for sign, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query):
        value = '"' + (quoted or word).rstrip("~").replace('"', "") + '"'
        {"+": must, "-": no}.get(sign, other).append(value)
    core = " AND ".join(must) if must else " OR ".join(other)
    if not core:
        raise QuerySyntaxError("nothing is asked for")
    return f"({core}) NOT ({' OR '.join(no)})" if no else core


def fuzzy(tokens: Column, word: str, distance: int = 1) -> Column:
    """Whether a token is within an edit distance of the word."""
    return F.exists(tokens, lambda t: F.levenshtein(t, F.lit(T.fold_py(word)), distance) >= 0)
