"""Line-first quality rules (native: DataFrame functions only).

Every line is judged by punctuation rules (symbols, shouting, a cut-off end), a navigation rule
(separators of menus and breadcrumbs) and boilerplate phrases; failing lines are removed; a
document that loses too much of its text is rejected. Base counts over the whole text reject
short and repetitive documents before that. :func:`judge` counts what would be lost,
:func:`filter_documents` passes the documents on without their failing lines.

Defined results: a null text counts as empty (no words, rejected as too short); rows
with null or repeated ids are judged by their text like any other; an empty table gives
an empty result; further columns of the input are kept by :func:`filter_documents` and
ignored by :func:`judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, words

#: The contract's thresholds.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule parameters, in hundredths of a line's words.
SYMBOL_PERCENT = 20  # symbols a word
SHOUT_PERCENT = 30  # words that end in two exclamation or question marks
BAR_PERCENT = 15  # separators a word
BARS = "|»›•·→"
#: A line of at most this many words that holds one of the phrases is boilerplate.
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "use of cookies",
)
#: A document is rejected when more than this share of its words is in removed lines.
MAX_LOST_PERCENT = 30


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _line_words(line: Column) -> Column:
    return F.size(words(line))


def line_fails(line: Column) -> Column:
    """True for a line with words that one of the rules removes."""

    def rules(n: Column) -> Column:
        symbols = _count(line, SYMBOLS) * 100 > n * SYMBOL_PERCENT
        shouts = F.regexp_count(line, F.lit(r"[!?][!?]")) * 100 > n * SHOUT_PERCENT
        bars = _count(line, BARS) * 100 > n * BAR_PERCENT
        trimmed = F.rtrim(line, F.lit(SPACES))
        cut_off = F.endswith(trimmed, F.lit("...")) | F.endswith(trimmed, F.lit("…"))
        low = F.lower(line)
        phrase = F.lit(False)
        for text in BOILERPLATE:
            phrase = phrase | F.contains(low, F.lit(text))
        return symbols | shouts | bars | cut_off | ((n <= BOILERPLATE_WORDS) & phrase)

    return let(_line_words(line), rules)


def _repeat_words(w: Column) -> Column:
    """Words in windows of five words that occur twice or more, the first occurrence included."""

    def from_hashes(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, i + 1)["h"] == x["h"]), F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["p"]))

        covered = F.aggregate(
            let(ordered, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, from_hashes))


def stats(text: Column) -> Column:
    """A struct of the base counts and the line rules' outcome for one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def by_words(w: Column) -> Column:
        def by_lines(x: Column) -> Column:
            lost = F.aggregate(F.filter(x, line_fails), F.lit(0), lambda n, line: n + _line_words(line))
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _count(t, SYMBOLS).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                lost.cast("long").alias("n_lost_words"),
            )

        return let(lines, by_lines)

    return let(words(t), by_words)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def passes(s: Column) -> Column:
    return ~base_failed(s) & (s["n_lost_words"] * 100 <= s["n_words"] * MAX_LOST_PERCENT)


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, base verdict and final verdict."""
    got = docs.select("doc_id", stats(F.col("text")).alias("_s"))
    s = F.col("_s")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")
    return got.select("doc_id", *[s[n].alias(n) for n in names], base_failed(s).alias("base_failed"), passes(s).alias("kept"))


def clean_text(text: Column) -> Column:
    """The text without the lines that the rules remove."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")) | ~line_fails(x)), "\n")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns, and without the lines that fail; ``n_chars`` counts the text that is left.

    A text without failing lines stays as it is.
    """
    flag = "_skerry_quality"
    # Generated, so that the filter is not moved before it and the counts are taken once.
    kept = docs.select("*", F.explode(F.array(stats(docs["text"]))).alias(flag)).where(passes(F.col(flag)))
    cleaned = F.col(flag)["n_lost_words"] > 0
    kept = kept.withColumn("text", F.when(cleaned, clean_text(F.col("text"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cleaned, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop(flag)


def _sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def count(col: str, chars: str) -> str:
        return f"(length({col}) - length(translate({col}, {lit(chars)}, '')))"

    phrases = " OR ".join(f"contains(lower(line), {lit(p)})" for p in BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT k, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT k, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s FROM p),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, {WINDOW})) AS o) GROUP BY k),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT k, line, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM l),
lines AS (SELECT k, line, n,
    {count("line", SYMBOLS)} * 100 > n * {SYMBOL_PERCENT}
    OR len(regexp_extract_all(line, '[!?][!?]')) * 100 > n * {SHOUT_PERCENT}
    OR {count("line", BARS)} * 100 > n * {BAR_PERCENT}
    OR regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z')
    OR (n <= {BOILERPLATE_WORDS} AND ({phrases})) AS bad
  FROM ln WHERE n > 0),
byline AS (SELECT k, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM lines GROUP BY k),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count("t", SYMBOLS)} AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_lost_words
  FROM w LEFT JOIN rep USING (k) LEFT JOIN byline USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_lost_words::BIGINT AS n_lost_words, base_failed,
  NOT base_failed AND n_lost_words * 100 <= n_words * {MAX_LOST_PERCENT} AS kept
FROM b"""


SQL = _sql()
