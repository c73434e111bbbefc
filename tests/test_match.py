"""The match language against SQLite's FTS5 (FTS-1..FTS-14)."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.plans import match

ROWS = [
    "alpha beta gamma delta",
    "the cat cat sat on the mat",
    "Café au lait, CAFÉ noir",
    "alpha gamma beta",
    "delta alpha x x x x x x x x x x beta",
    "organizations and organization",
    "a_b joined a b",
    "",
    "2nd x3y alphabet alphanumeric",
    "beta alpha",
]
QUERIES = [
    "alpha", "ALPHA", "alpha beta", "alpha AND beta", "alpha OR cat", "alpha NOT beta", "alpha NOT beta gamma", "alpha OR beta AND gamma", "(alpha OR cat) AND beta",
    '"alpha beta"', "alpha + beta", '"the cat cat"', "alph*", '"alpha b"*', "alph* beta", "^alpha", "^beta alpha", "NEAR(alpha beta)", "NEAR(alpha delta, 1)", "NEAR(alpha delta, 2)",
    "NEAR(alpha beta, 9)", "NEAR(alpha beta, 10)", 'NEAR("alpha beta" delta, 1)', "near", "and", "not", "cafe", "CAFÉ", "a_b", "organization", "chunk_text : alpha", "path : alpha",
    "{chunk_text path} : alpha", "- chunk_text : alpha", "- path : alpha", "chunk_text : (alpha OR cat)", '"al""pha"', "2nd", "alpha NOT (beta OR delta)", "(alpha)", "((alpha OR beta))",
    "alpha NOT beta NOT gamma", "alpha AND beta NOT gamma", "alpha OR beta NOT gamma", '"?"', 'alpha "?"', "NEAR(alpha)", "cat cat", "mat the", "NEAR(the mat cat, 3)",
    # errors
    "", "?", "alpha,", "al'pha", "a.b", "a/b", "alpha~", "+alpha", "alpha AND", "NOT alpha", '"open', "(alpha", "alpha)", "(alpha OR beta) gamma", "alpha (beta OR gamma)", "a-b", "nocol : alpha",
    "alpha OR OR beta", "NEAR(alpha beta, x)", "foo(alpha beta)", "alpha AND NOT beta", "^", "*",
]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE chunks USING fts5(path UNINDEXED, chunk_text)")
    con.executemany("INSERT INTO chunks(rowid, path, chunk_text) VALUES (?, 'alpha', ?)", list(enumerate(ROWS)))
    return con


def expected(fts, query):
    try:
        return sorted(r[0] for r in fts.execute("SELECT rowid FROM chunks WHERE chunks MATCH ?", [query]))
    except sqlite3.OperationalError:
        return "error"


def test_match_conformance(spark, fts):
    rows = spark.createDataFrame(list(enumerate(ROWS)), "id int, text string").withColumn("tokens", T.tokens(F.col("text"))).cache()
    asked, got = {}, {}
    for q in QUERIES:
        want = expected(fts, q)
        try:
            asked[q] = match.parse(q)
        except match.QuerySyntaxError:
            got[q] = "error"
        assert (q in got) == (want == "error"), (q, want)
    cols = [match.compile_match(n, F.col("tokens")).alias(f"q{i}") for i, n in enumerate(asked.values())]
    table = rows.select("id", *cols).collect()
    for i, q in enumerate(asked):
        assert sorted(r["id"] for r in table if r[f"q{i}"]) == expected(fts, q), q


def test_folding_equals_fts5(spark):
    """Letters with marks, composed and not, against the tokens of SQLite: every Latin letter with a mark, and combining marks."""
    import unicodedata

    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    texts = ["cafés cafe\u0301s", "İstanbul ǎ ș ơ", "a\u0301b a\u0488b", "Ångström ſo"] + [f"x{chr(c)}y {unicodedata.normalize('NFD', chr(c))}" for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = {}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want.setdefault(doc, []).append(term)
    got = {r["id"]: r["tk"] for r in spark.createDataFrame(list(enumerate(texts)), "id int, x string").select("id", T.tokens(F.col("x")).alias("tk")).collect()}
    assert got == {k: want.get(k, []) for k in range(len(texts))}
    assert match.split_words("cafe\u0301s İSTANBUL") == ("cafes", "istanbul")


def test_tokens_are_bound_once(spark):
    df = spark.createDataFrame([(1, "a b c")], "id int, text string")
    plan = df.where(match.compile_match(match.parse("(a OR b) AND c NOT d"), T.tokens(F.col("text"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("query", ["alpha beta", '"alpha beta"', '"the cat" "cat cat"', "cafe", "alph*", "alpha OR mat", "^delta"])
def test_snippet_equals_fts5(fts, query):
    wanted = [(p.tokens, p.prefix, p.initial) for p in match.phrases_of(match.parse(query))]
    for rowid, text in fts.execute("SELECT rowid, snippet(chunks, 1, '...', '...', '...', 64) FROM chunks WHERE chunks MATCH ?", [query]):
        assert match.snippet_of(ROWS[rowid], wanted, "...", "...", "...", 64) == text


def test_lenient_and_fields(spark):
    assert match.parse("a AND NOT b", lenient=True) == match.parse("a NOT b")
    df = spark.createDataFrame([(1, "x y", "Smith", 2020), (2, "x", "Jones", 2020)], "id int, text string, author string, year int")
    node = match.parse("x AND author:smith AND year:2020", fields=frozenset(("author", "year")))
    hit = match.compile_match(node, T.tokens(F.col("text")), metadata={"author": F.col("author"), "year": F.col("year")})
    assert [r["id"] for r in df.where(hit).collect()] == [1]


def test_signs_and_fuzzy(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "alpna")], "id int, text string").withColumn("tk", T.tokens(F.col("text")))
    ids = lambda q: [r["id"] for r in df.where(match.compile_match(match.parse(match.from_signs(q)), F.col("tk"))).collect()]
    assert ids("+alpha -beta") == [2]
    assert [r["id"] for r in df.where(match.fuzzy(F.col("tk"), "alpha")).collect()] == [1, 2, 3]
