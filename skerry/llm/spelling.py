"""Grouping of spelling variants by errata-trie merging.

The dictionary (distinct words with their counts) is a trie, kept as a table of nodes: a node is
the hash of a prefix, its children are counted by an aggregation over all prefixes of all words.
The child with most words below it is heavy, the others are light, and so is the end of a word
at an inner node. A word has at most log2 of the dictionary's size light edges on its path.

At each light edge the word's branch is merged into the node's other branches, smaller into
larger, with one error at that place: its character is replaced by the heavy one, is skipped, or
the heavy one is put before it. Terminals that coincide are pairs at one edit:

* a merged branch with an original word: the keys joined with the dictionary;
* two light branches of one node, both with their character replaced: equal keys of one place
  (at most as many as there are letters).

Every pair is found, at the first place where the two words differ: at most one of its two
branches is heavy there, and the light one is merged with just that error. The keys are whole
words, so what coincides needs no further check, and a hash collision of prefixes costs nothing
(all that matters is that all words of a node see one heavy child).

Tasks count words in a dictionary of bounded size, so a common word is one row of each task. The
trie's nodes are counted with map-side combine; the join that finds light edges has hot keys at
the first letters, whose words' side Spark's skew join divides. Nothing is broadcast or gathered.

Defined results: a null text has no words; a null doc_id counts as the empty string in the hash
of a run; a repeated row counts again; very long runs are words like any other (their prefixes are
rows of two numbers and a letter); ties of form go to the word first in code-point order; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, scratch

MIN_LETTERS, MIN_COUNT = 6, 5
#: A form has at least this many times the word's count.
FORM_RATIO = 5
#: Runs whose hash this divides lose a letter.
ERROR_EVERY = 199
#: Distinct words that a task counts before it passes them on.
HELD = 300_000


def count_words(docs: DataFrame, min_letters: int = MIN_LETTERS, error_every: int = ERROR_EVERY) -> DataFrame:
    """(word, n): the words of at least ``min_letters`` letters of all texts, with the errors that their hashes name."""
    # a run one letter longer may lose one; shorter runs can't give a word
    find = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters).findall

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                # bytes.lower() changes A-Z only
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % error_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_letters:
                            continue
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield _counts(held)
                held = {}
        if held:
            yield _counts(held)

    each = docs.select("doc_id", "text").mapInArrow(released(run), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def light_edges(words: DataFrame) -> DataFrame:
    """``words``: (id, word). (id, at, heavy): the places where a word's branch is light, and the heavy letter there."""
    letter = lambda i: F.struct(F.xxhash64(F.substring(F.col("word"), F.lit(1), i)).alias("node"), F.substring(F.col("word"), i + 1, F.lit(1)).alias("letter"))
    paths = words.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("word")), letter)).alias("at", "p")).select("id", "at", "p.node", "p.letter")
    children = paths.groupBy("node", "letter").agg(F.count("*").alias("n"))
    inner = children.groupBy("node").agg(F.count("*").alias("children"), F.max(F.when(F.col("letter") != "", F.struct("n", "letter"))).alias("most"))
    heavy = materialize(inner.where("children > 1").select("node", F.col("most.letter").alias("heavy")))  # a table of its own, so that Spark may divide the hot nodes of the join
    return paths.join(heavy, "node").where("letter <> heavy").select("id", "at", "heavy")


def near_pairs(words: DataFrame) -> DataFrame:
    """``words``: (id long, word), distinct. (a, b) ids, both ways, of words that differ by exactly one inserted, deleted or replaced letter."""
    before, after = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, F.length("word"))
    rest = F.substring(F.col("word"), F.col("at") + 2, F.length("word"))
    inside = F.col("at") < F.length("word")
    merged = F.array_compact(
        F.array(
            F.struct(F.lit("put").alias("error"), F.concat(before, F.col("heavy"), after).alias("key")),
            F.when(inside, F.struct(F.lit("replace").alias("error"), F.concat(before, F.col("heavy"), rest).alias("key"))),
            F.when(inside, F.struct(F.lit("skip").alias("error"), F.concat(before, rest).alias("key"))),
        )
    )
    branches = materialize(light_edges(words).join(words, "id").select("id", "at", F.explode(merged).alias("m")).select("id", "at", "m.error", "m.key"))
    with_words = branches.select(F.col("id").alias("a"), "key").join(words.select(F.col("word").alias("key"), F.col("id").alias("b")), "key").select("a", "b")
    replaced = branches.where("error = 'replace'")
    each_other = replaced.select(F.col("id").alias("a"), "key", "at").join(replaced.select(F.col("id").alias("b"), "key", "at"), ["key", "at"]).where("a < b").select("a", "b")
    once = with_words.unionByName(each_other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: (id, form), form null or a word with a larger count. (id, root): forms followed to the last, the length of the steps doubled each round."""
    now = materialize(forms.select("id", F.coalesce("form", "id").alias("root")))
    while True:
        further = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select("id", "root", "next")
        step = materialize(further.select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = step.select("id", "root")
        if step.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, error_every: int = ERROR_EVERY) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of at least ``min_letters`` letters that occurs ``min_count`` times.

    A word's form is its near word with the largest n, if that is at least ``ratio`` times its own.
    """
    with scratch() as keep:
        counted = count_words(docs, min_letters, error_every).where(F.col("n") >= min_count)
        words = keep(materialize(counted.withColumn("id", F.monotonically_increasing_id())))
        other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        best = near_pairs(words.select("id", "word")).join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near", F.col("b").alias("form_id"))).alias("best"))
        real = -F.col("best.order") >= ratio * F.col("n")
        best = words.join(best, "id", "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(real, F.col(c)).alias(a) for c, a in (("best.near", "form"), ("best.form_id", "form_id"))], F.when(real, -F.col("best.order")).alias("form_n"))
        best = keep(materialize(best))
        last = keep(materialize(_root_words(best, words)))
    return words.join(best, "id").join(last, "id").select("word", "form", "root", "n", "n_near", "form_n")


def _root_words(best: DataFrame, words: DataFrame) -> DataFrame:
    last = roots(best.select("id", F.col("form_id").alias("form"))).withColumnRenamed("root", "root_id")
    return last.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
