"""Thesaurus: loading, query expansion and tagging (SRC-13, STR-6, STR-7, JOIN-12, SP-20)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Concepts and synonyms that may be broadcast, and those that are compiled into a plan.
MAX_TERMS, COMPILED = 100_000, 200


def load(path: str) -> dict[str, list[str]]:
    """concept -> synonyms; what is missing, empty or malformed gives nothing."""
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError):
        return {}
    concepts = data.get("concepts") if isinstance(data, dict) else None
    if not isinstance(concepts, dict):
        return {}
    out = {}
    for concept, values in concepts.items():
        if isinstance(values, str):
            found = [values]
        elif isinstance(values, list | tuple | set | dict):
            found = [str(v) for v in values if v]
        else:
            found = []
        out[T.normalise_dashes(str(concept))] = [T.normalise_dashes(v) for v in found]
    return out


def _holds(query: str, term: str) -> bool:
    return bool(term) and re.search(rf"\b{re.escape(term.lower())}\b", query) is not None


def matched_concepts(query: str, thesaurus: dict[str, list[str]]) -> dict[str, list[str]]:
    low = T.normalise_dashes(query).lower()
    return {c: s for c, s in thesaurus.items() if any(_holds(low, t) for t in [c, *s])}


def expand_terms(query: str, thesaurus: dict[str, list[str]]) -> list[str]:
    """The query's words and, for each concept named in it, the concept and all its synonyms; sorted."""
    terms = set(query.split())
    for concept, synonyms in matched_concepts(query, thesaurus).items():
        terms |= {concept, *synonyms}
    return sorted(terms)


def expand_query(query: str, thesaurus: dict[str, list[str]]) -> str:
    """A match query: the words that must be there, or any phrase of the concepts they name (Q-6)."""
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    words = " AND ".join(quoted(w) for w in T.normalise_dashes(query).split())
    groups = [" OR ".join(quoted(t) for t in dict.fromkeys([c, *s])) for c, s in matched_concepts(query, thesaurus).items()]
    return " OR ".join(x for x in [f"({words})" if words else "", *[f"({g})" for g in groups]] if x)


def frame(spark: SparkSession, thesaurus: dict[str, list[str]]) -> DataFrame:
    rows = [(c, t) for c, s in thesaurus.items() for t in dict.fromkeys([c, *s])]
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the thesaurus has {len(rows)} terms; at most {MAX_TERMS} can be broadcast")
    return spark.createDataFrame(rows, "concept string, term string")


def tag(docs: DataFrame, thesaurus: dict[str, list[str]], key: str, text: str = "text") -> DataFrame:
    """(key, concept) for each concept that a document names: one pass, no join. Up to COMPILED terms are compiled into the
    plan; more are looked for by their words, in a table that goes to the tasks, so that the plan stays as it is."""
    n = sum(len(s) + 1 for s in thesaurus.values())
    if n > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms can be sent to the tasks")
    from ..plans.match import joined, split_words

    if n > COMPILED:
        return _tag_by_words(docs, thesaurus, key, text)
    s = F.col("_joined")
    found = []
    for concept, synonyms in thesaurus.items():
        hit = F.lit(False)
        for term in dict.fromkeys([concept, *synonyms]):
            words = split_words(term)
            if words:
                hit = hit | F.contains(s, F.lit(" " + " ".join(words) + " "))
        found.append(F.when(hit, F.lit(concept)))
    base = docs.select(key, joined(T.tokens(F.col(text))).alias("_joined"))
    return base.select(key, F.explode(F.array_compact(F.array(*found) if found else F.array().cast("array<string>"))).alias("concept"))


def _tag_by_words(docs: DataFrame, thesaurus: dict[str, list[str]], key: str, text: str) -> DataFrame:
    """The same with terms as tuples of words: at each token, the terms that begin with it are compared, by their lengths."""
    from ..plans.match import split_words

    concepts: dict[tuple, set[str]] = {}
    for concept, synonyms in thesaurus.items():
        for term in (concept, *synonyms):
            if words := split_words(term):
                concepts.setdefault(words, set()).add(concept)
    lengths: dict[str, set[int]] = {}
    for words in concepts:
        lengths.setdefault(words[0], set()).add(len(words))
    sent = docs.sparkSession.sparkContext.broadcast((concepts, lengths))

    def run(batches):
        import pyarrow as pa

        known, sizes = sent.value
        for batch in batches:
            found = []
            for tokens in batch.column(1).to_pylist():
                named: set[str] = set()
                for i, t in enumerate(tokens):
                    for n in sizes.get(t, ()):
                        named |= known.get(tuple(tokens[i : i + n]), set())
                found.append(sorted(named))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "concepts"])

    rows = docs.select(key, T.tokens(F.col(text)).alias("_tokens")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, concepts array<string>")
    return rows.select(key, F.explode("concepts").alias("concept"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(concept, ancestor, steps) of a hierarchy (narrower, broader): all that is broader, by the fewest steps, and itself (SP-20).

    Rounds double the steps that are known, so there are as many as the logarithm of the depth; each is a table in the shared
    folder. Concepts may have several broader ones, and circles end by themselves; rows with nulls say nothing.
    """
    import uuid

    from ..session import shared_folder

    spark = edges.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/ancestors-{uuid.uuid4().hex}"
    both = edges.select(F.col("narrower").cast("string").alias("concept"), F.col("broader").cast("string").alias("ancestor")).where("concept IS NOT NULL AND ancestor IS NOT NULL")
    itself = both.select("concept").union(both.select("ancestor")).select("concept", F.col("concept").alias("ancestor"), F.lit(0).alias("steps"))
    least = lambda rows: rows.groupBy("concept", "ancestor").agg(F.min("steps").alias("steps"))
    state = lambda: known.agg(F.count("*"), F.sum("steps")).first()
    least(itself.union(both.withColumn("steps", F.lit(1)))).write.parquet(f"{at}/0")
    known, number, then = spark.read.parquet(f"{at}/0"), 0, None
    while (now := state()) != then:
        then, number = now, number + 1
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.concept"))
        least(further.select("a.concept", "b.ancestor", (F.col("a.steps") + F.col("b.steps")).alias("steps"))).write.parquet(f"{at}/{number}")
        known = spark.read.parquet(f"{at}/{number}")
    return known


def similarity(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """concept_a, concept_b, ancestor, path, similarity of pairs of concepts (SP-20).

    ``path`` is the fewest steps from one to the other through something broader than both (or one of them), ``ancestor`` that
    concept (of several, the first), ``similarity`` 1 / (1 + path). Pairs without one have null and 0; equal pairs count once.
    """
    asked, up = pairs.select("concept_a", "concept_b").distinct(), ancestors(edges)
    a = up.select(F.col("concept").alias("concept_a"), "ancestor", F.col("steps").alias("_a"))
    b = up.select(F.col("concept").alias("concept_b"), "ancestor", F.col("steps").alias("_b"))
    met = asked.join(a, "concept_a").join(b, ["concept_b", "ancestor"])
    best = met.groupBy("concept_a", "concept_b").agg(F.min(F.struct((F.col("_a") + F.col("_b")).alias("path"), "ancestor")).alias("m"))
    found = asked.alias("p").join(best.alias("q"), F.col("p.concept_a").eqNullSafe(F.col("q.concept_a")) & F.col("p.concept_b").eqNullSafe(F.col("q.concept_b")), "left")
    return found.select("p.concept_a", "p.concept_b", "q.m.ancestor", "q.m.path", F.coalesce(1 / (1 + F.col("q.m.path")), F.lit(0.0)).alias("similarity"))
