"""Text expressions: white space, tokens, folding, highlighting, ids, years (STR-*, TR-6, TR-7, DATE-1, FIL-7)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip() and str.split() take for white space.
UNICODE_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Combining marks that folding drops, so that they join the letters around them.
COMBINING = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with one mark and what they fold to, from their Unicode decompositions."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).lower() == chr(c)]
    base = {c: d[0] for c in letters if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and d[0].isalpha()}
    base |= {"\u017f": "s", "\u1e9b": "s"}
    return "".join(base), "".join(base.values())


#: What folding replaces and drops: the characters past the end of PLAIN have nothing in their place.
MARKED, PLAIN = _folding()
MARKED += COMBINING
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
DASHES = "‐‑‒–—―−"

_CLASS = "[" + UNICODE_SPACES.replace("\\", "\\\\") + "]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also for uses inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(UNICODE_SPACES))


def clean(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends (STR-1)."""
    return F.trim(F.regexp_replace(text, f"{_CLASS}+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded maximal runs of letters, numbers and private-use characters (FTS-1)."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold_py(text: str) -> str:
    """The same folding for query strings, on the driver."""
    return text.lower().translate(str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :]))


def normalise_dashes(text: str) -> str:
    return text.translate(dict.fromkeys(map(ord, DASHES), "-"))


def quote(literal: str) -> str:
    """A Java pattern that matches the string itself."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in literal)


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>", whole_words: bool = False) -> Column:
    """Mark every term, the one listed first winning at a place; without regard to case (STR-2)."""
    terms = [t for t in terms if t]
    if not terms:
        return text
    pattern = "|".join(map(quote, terms))
    edge = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") if whole_words else ("", "")
    return F.regexp_replace(text, f"(?iu){edge[0]}({pattern}){edge[1]}", f"{before}$1{after}")


def query_terms(query: str) -> list[str]:
    """Words of a plain query (STR-3)."""
    return query.split()


def advanced_terms(query: str) -> list[str]:
    """Quoted phrases and words of a match query, without operators' signs (STR-4)."""
    found = [a or b for a, b in re.findall(r'"([^"]*)"|([\w*]+)', query)]
    return [t.strip('+-"~*') for t in found if t.strip('+-"~*') and t not in ("AND", "OR", "NOT", "NEAR")]


def shorten(text: Column, width: int = 300, mark: str = " [...]") -> Column:
    """Collapsed text, cut at a word's end so that it has at most ``width`` characters with its mark (STR-5)."""
    c = clean(text)
    cut = F.regexp_extract(F.concat(c, F.lit(" ")), f"^(.{{0,{width - len(mark)}}})(?= )", 1)
    return F.when(F.length(c) <= width, c).otherwise(F.when(F.length(cut) > 0, F.concat(F.rtrim(cut), F.lit(mark))).otherwise(F.lit(mark.strip())))


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot, or empty (STR-9)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def item_uri(item_id: Column) -> Column:
    """The one canonical id of a library item (TR-6, Q-1)."""
    return F.concat(F.lit("library:"), item_id.cast("string"))


def item_id(uri: Column) -> Column:
    """The number in a canonical id, or null (TR-7)."""
    return F.regexp_extract(uri, r"^library:(-?[0-9]+)$", 1).try_cast("long")


def year_of(date: Column) -> Column:
    """The number before the first dash of a free-form date, or null (DATE-1)."""
    return F.trim(F.element_at(F.split(date, "-"), 1)).try_cast("int")


def garbled_share(text: Column) -> Column:
    """Share of visible characters that are neither letters, numbers nor common punctuation (SP-12)."""
    seen = F.regexp_replace(text, r"[ \t\n\x0B\f\r]", "")
    odd = F.regexp_replace(seen, r"[\p{L}\p{N}.,;:!?'\"()-]", "")
    return F.when(F.length(seen) > 0, F.length(odd) / F.length(seen)).otherwise(F.lit(0.0))


def strip_html(html: Column) -> Column:
    """Markup removed by patterns, for short notes; scripts and styles go with their content (STR-8)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))
