"""Similarity of concepts in a hierarchy, against a search of the graph."""

from skerry.sources import thesaurus

EDGES = [("cat", "feline"), ("lion", "feline"), ("feline", "mammal"), ("dog", "mammal"), ("dog", "pet"), ("cat", "pet"), ("mammal", "animal"), ("pet", "animal"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", None), (None, "animal"), ("cat", "feline")]
EDGES += [(f"n{k}", f"n{k + 1}") for k in range(20)]


def brute(concept):
    known, front, steps = {concept: 0}, [concept], 0
    while front:
        steps += 1
        front = [b for a, b in EDGES if a in front and b and b not in known]
        known |= dict.fromkeys(front, steps)
    return known


def test_concept_similarity(spark):
    edges = spark.createDataFrame(EDGES, "narrower string, broader string")
    got = {}
    for r in thesaurus.ancestors(edges).collect():
        got.setdefault(r["concept"], {})[r["ancestor"]] = r["steps"]
    names = {x for a, b in EDGES if a and b for x in (a, b)}
    assert got == {n: brute(n) for n in names}

    pairs = [("cat", "lion"), ("cat", "dog"), ("lion", "dog"), ("cat", "feline"), ("a", "c"), ("cat", "a"), ("cat", "cat"), ("n0", "n20"), ("cat", "unknown"), (None, "cat"), ("cat", "lion")]
    rows = thesaurus.similarity(spark.createDataFrame(pairs, "concept_a string, concept_b string"), edges).collect()
    assert len(rows) == len(set(pairs))
    for r in rows:
        up, other = brute(r["concept_a"]) if r["concept_a"] in names else {}, brute(r["concept_b"]) if r["concept_b"] in names else {}
        met = sorted((up[x] + other[x], x) for x in up if x in other)
        want = (met[0][1], met[0][0], 1 / (1 + met[0][0])) if met else (None, None, 0.0)
        assert (r["ancestor"], r["path"], r["similarity"]) == want, r
    empty = edges.limit(0)
    assert thesaurus.similarity(spark.createDataFrame(pairs, "concept_a string, concept_b string"), empty).where("similarity > 0").count() == 0
