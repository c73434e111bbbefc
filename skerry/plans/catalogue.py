"""The registered queries of the retrieval engine with their SQL counterparts.

The harness' tables stand in for the engine's: documents are documents, ``source`` their path,
embeddings join documents by number, orders carry dates, lineitem and part are attribute rows.
Every query runs over its whole tables; a limit stands only where a top-k is the feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import facets, rank
from ..session import shared_folder
from ..sources import library, thesaurus
from . import match

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_SPACES = T._CLASS
_FOLDED = f"translate(lower(text), '{T.MARKED}', '{T.PLAIN}')"
_TK = f"regexp_extract_all({_FOLDED}, '{T.TOKEN}')"
_JOINED = f"(' ' || array_to_string({_TK}, ' ') || ' ')"
_CHUNKS = f"""
cut AS (SELECT doc_id, source, text AS whole, unnest(range(0, length(text), 250)) AS st FROM documents),
chunks AS (SELECT doc_id, source, (st // 250)::INT AS chunk_id, st::INT AS start,
  regexp_replace(substring(whole, st + 1, 300), '^{_SPACES}+|{_SPACES}+$', '', 'g') AS text FROM cut)
"""
THESAURUS = {
    "motion": ["ation", "tion", "ing to"],
    "place": ["in the", "dans", "heit", "para"],
    "person": ["er", "he", "vous", "ich"],
}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents")


def _tokens(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", *more, T.tokens(F.col("text")).alias("tokens"))


def _matching(spark: SparkSession, d: str, text: str) -> DataFrame:
    return _tokens(spark, d).where(match.compile_match(match.parse(text), F.col("tokens"))).select("doc_id")


# Chunks and tokens


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, start, text AS chunk_text FROM chunks WHERE text <> ''")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(_docs(spark, d).select("doc_id", "text"))


@query(f"""WITH t AS (SELECT doc_id, {_TK} AS tk FROM documents), w AS (SELECT doc_id, tk, unnest(range(0, len(tk), 320)) AS st FROM t)
SELECT doc_id, (st // 320)::INT AS chunk_id, st::INT AS start, len(tk[st + 1:st + 400])::INT AS n_tokens, tk[st + 1] AS first_token FROM w""")
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    got = C.chunk_tokens(_docs(spark, d).select("doc_id", "text"))
    return got.select("doc_id", "chunk_id", "start", F.size("tokens").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first_token"))


@query(f"""WITH {_CHUNKS}, f AS (SELECT DISTINCT doc_id FROM chunks WHERE text <> '' ORDER BY doc_id LIMIT 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS r FROM chunks WHERE text <> '' AND doc_id IN (SELECT doc_id FROM f)),
c AS (SELECT doc_id, chunk_id, trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')) AS t FROM r WHERE r <= 2)
SELECT doc_id, chunk_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(regexp_extract(t || ' ', '^(.{{0,114}}) ', 1)) || ' [...]' END AS preview FROM c""")
def preview_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.preview(C.chunk(_docs(spark, d).select("doc_id", "text")), width=120)


@query(f"WITH t AS (SELECT doc_id, {_TK} AS tk FROM documents) SELECT doc_id, len(tk)::INT AS n_tokens, len(list_distinct(tk))::INT AS n_distinct FROM t")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


# Match language


@query(f"""WITH {_CHUNKS}, t AS (SELECT *, {_JOINED} AS j FROM chunks WHERE text <> '')
SELECT doc_id, chunk_id, regexp_replace(text, '(the|of)', '<mark>\\1</mark>', 'gi') AS snippet FROM t
WHERE contains(j, ' the ') AND contains(j, ' of ') AND NOT contains(j, ' and ') ORDER BY doc_id, chunk_id LIMIT 10""")
def match_and_not(spark: SparkSession, d: str) -> DataFrame:
    node = match.parse("the of NOT and")
    chunks = C.chunk(_docs(spark, d).select("doc_id", "text"))
    hits = chunks.where(match.compile_match(node, T.tokens(F.col("chunk_text"))))
    top = hits.orderBy("doc_id", "chunk_id").limit(10)
    return top.select("doc_id", "chunk_id", T.highlight(F.col("chunk_text"), match.terms_of(node)).alias("snippet"))


@query(f"SELECT doc_id FROM documents WHERE (contains({_JOINED}, ' eau ') OR contains({_JOINED}, ' der ')) AND contains({_JOINED}, ' la ')")
def match_or_group(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "(eau OR der) AND la")


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' fur ') OR contains({_JOINED}, ' e ')")
def match_folded(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "FÜR OR è")


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' of the ')")
def match_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, '"of the"')


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' thr')")
def match_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "thr*")


@query(f"""WITH t AS (SELECT doc_id, {_TK} AS tk FROM documents), p AS (SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS i FROM t)
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 'the' AND b.w = 'of' AND abs(a.i - b.i) <= 3""")
def match_near(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "NEAR(the of, 2)")


@query(f"SELECT doc_id FROM documents WHERE starts_with({_JOINED}, ' the ')")
def match_initial(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "^the")


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' des ')")
def match_column(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "chunk_text : des OR path : the")


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' la ') AND contains({_JOINED}, ' de ') AND NOT contains({_JOINED}, ' et ')")
def match_signs(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, match.from_signs("+la +de -et"))


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' the ') AND contains(lower(lang), 'en') AND contains(source, 'src1')")
def match_fields(spark: SparkSession, d: str) -> DataFrame:
    node = match.parse("the AND lang:en AND source:src1", fields=frozenset(("lang", "source")))
    got = _tokens(spark, d, "lang", "source")
    return got.where(match.compile_match(node, F.col("tokens"), metadata={"lang": F.col("lang"), "source": F.col("source")})).select("doc_id")


@query(f"WITH t AS (SELECT doc_id, {_TK} AS tk FROM documents) SELECT doc_id FROM t WHERE len(list_filter(tk, lambda w: levenshtein(w, 'thend') <= 1)) > 0")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).where(match.fuzzy(F.col("tokens"), "thend", 1)).select("doc_id")


@query(f"SELECT doc_id, source FROM documents WHERE contains({_JOINED}, ' the ') ORDER BY doc_id LIMIT 25")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    hit = match.compile_match(match.parse("the"), F.col("tokens"))
    return _tokens(spark, d, "source").where(hit).select("doc_id", "source").orderBy("doc_id").limit(25)


@query(f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' the ') AND contains({_JOINED}, ' of ') AND contains({_JOINED}, ' and ')")
def search_within_search(spark: SparkSession, d: str) -> DataFrame:
    return facets.within(_matching(spark, d, "and"), _matching(spark, d, "the of"), ["doc_id"])


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(' ' || array_to_string(regexp_extract_all(" + _FOLDED + f", '{T.TOKEN}'), ' ') || ' ', ' the ') AND role = 'user'")
def conversation_search(spark: SparkSession, d: str) -> DataFrame:
    got = _t(spark, d, "conversations").where("role = 'user'")
    return got.where(match.compile_match(match.parse("the"), T.tokens(F.col("text")))).select("conv_id", "turn", "role")


# Text functions


@query("SELECT doc_id, md5(regexp_replace(text, '(the|eau|der)', '<mark>\\1</mark>', 'gi')) AS marked FROM documents")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.highlight(F.col("text"), ["the", "eau", "der"]).cast("binary")).alias("marked"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACES}+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("cleaned"))


_NO_TAGS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _NO_TAGS = f"replace({_NO_TAGS}, '{_name}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({_NO_TAGS}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS page_text FROM pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("page_text"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') AS seen FROM documents)
SELECT doc_id, round(CASE WHEN length(seen) > 0 THEN length(regexp_replace(seen, '[\p{L}\p{N}.,;:!?''"()-]', '', 'g'))::DOUBLE / length(seen) ELSE 0 END, 9) AS share,
  (CASE WHEN length(seen) > 0 THEN length(regexp_replace(seen, '[\p{L}\p{N}.,;:!?''"()-]', '', 'g'))::DOUBLE / length(seen) ELSE 0 END) > 0.2 AS garbled FROM t""")
def garbled_text_flag(spark: SparkSession, d: str) -> DataFrame:
    share = T.garbled_share(F.col("text"))
    return _docs(spark, d).select("doc_id", F.round(share, 9).alias("share"), (share > 0.2).alias("garbled"))


@query("SELECT page_id, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS suffix, list_last(string_split(url, '/')) AS basename FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.suffix(F.col("url")).alias("suffix"), T.basename(F.col("url")).alias("basename"))


@query("SELECT o_orderkey, try_cast(trim(string_split(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-00 x') WHEN 1 THEN 'n.d.' WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y') END, '-')[1]) AS INT) AS year FROM orders")
def year_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-00 x"))).when(kind == 1, F.lit("n.d.")).when(kind == 2, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return _t(spark, d, "orders").select("o_orderkey", T.year_of(text).alias("year"))


# Ranking


@query(f"""WITH w AS (SELECT doc_id, unnest({_TK}) AS w FROM documents),
c AS (SELECT doc_id, (('0x' || substring(md5(w), 1, 6))::BIGINT % 384)::INT AS dim, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt((sum(n * n) OVER (PARTITION BY doc_id))::DOUBLE), 9) AS weight FROM c""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    got = rank.hash_embedding(_docs(spark, d), ["doc_id"])
    return got.select("doc_id", "dim", F.round("weight", 9).alias("weight"))


_BM25 = f"""t AS (SELECT doc_id, {_TK} AS tk FROM documents),
f AS (SELECT doc_id, len(tk)::DOUBLE AS dl, len(list_filter(tk, lambda w: w = 'the'))::DOUBLE AS a, len(list_filter(tk, lambda w: w = 'of'))::DOUBLE AS b FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, (count(*) FILTER (WHERE a > 0))::DOUBLE AS da, (count(*) FILTER (WHERE b > 0))::DOUBLE AS db FROM f),
bm AS (SELECT doc_id, ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))
  + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS raw FROM f, s WHERE a > 0 OR b > 0)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return rank.bm25(_tokens(spark, d), ["the", "of"], ["doc_id"]).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT doc_id, round(raw, 6) AS score FROM bm ORDER BY round(raw, 6) DESC, doc_id LIMIT 10")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(10)


_Q0 = "(SELECT embedding::DOUBLE[64] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _t(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def _knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = _t(spark, d, "embeddings")
    near = rank.knn(v, _first_vector(spark, d), k * 2, ["vec_id"]).withColumn("distance", F.round("distance", 6))
    return near.orderBy("distance", "vec_id").limit(k)


@query(f"SELECT vec_id, round(pow(array_distance(embedding::DOUBLE[64], q), 2), 6) AS distance FROM embeddings, {_Q0} ORDER BY 2, 1 LIMIT 10")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 10).select("vec_id", "distance")


@query(f"SELECT vec_id, round(pow(array_distance(embedding::DOUBLE[64], q), 2), 6) AS distance FROM embeddings, {_Q0} ORDER BY 2, 1 LIMIT 10")
def knn_ivf(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    centres = rank.ivf_centres(v, 32, ["vec_id"])
    near = rank.ivf_knn(rank.ivf_index(v, centres), centres, _first_vector(spark, d), 20, ["vec_id"]).withColumn("distance", F.round("distance", 6))
    return near.orderBy("distance", "vec_id").limit(10).select("vec_id", "distance")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[64] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(pow(array_distance(embedding::DOUBLE[64], qv), 2), 6) AS distance FROM embeddings, q)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rank.knn_batch(v, q, 10, ["vec_id"], digits=6)


@query("SELECT vec_id, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127, 12) AS scale, list_transform(embedding::DOUBLE[], lambda x: round(x / (list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y))) / 127))::INT) AS codes FROM embeddings")
def quantise_int8(spark: SparkSession, d: str) -> DataFrame:
    q = rank.quantise(F.col("embedding"))
    return _t(spark, d, "embeddings").select("vec_id", q.alias("q")).select("vec_id", F.round("q.scale", 12).alias("scale"), F.col("q.codes").cast("array<int>").alias("codes"))


_SEM = f"sem AS (SELECT vec_id AS doc_id, round(pow(array_distance(embedding::DOUBLE[64], q), 2), 6) AS distance FROM embeddings, {_Q0} ORDER BY 2, 1 LIMIT 50)"
_KEY = "kw AS (SELECT doc_id, round(raw, 6) AS score FROM bm ORDER BY 2 DESC, 1 LIMIT 50)"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sem = _knn(spark, d, 50).select(F.col("vec_id").alias("doc_id"), "distance")
    return sem, _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""WITH {_BM25}, {_SEM}, {_KEY},
a AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS r FROM sem), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM kw)
SELECT doc_id, round(coalesce(1 / (60 + a.r::DOUBLE), 0) + coalesce(1 / (60 + b.r::DOUBLE), 0), 8) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    sem, kw = _parts(spark, d)
    a = rank.ranked(sem, [F.col("distance"), F.col("doc_id")], "rank_a", 50).select("doc_id", "rank_a")
    b = rank.ranked(kw, [F.desc("score"), F.col("doc_id")], "rank_b", 50).select("doc_id", "rank_b")
    return rank.rrf(a, b, ["doc_id"]).select("doc_id", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""WITH {_BM25}, {_SEM}, {_KEY}, u AS (SELECT doc_id, 0 AS source_rank, distance AS o FROM sem WHERE distance < 1.2
UNION ALL SELECT doc_id, 1, -score FROM kw WHERE doc_id NOT IN (SELECT doc_id FROM sem WHERE distance < 1.2))
SELECT doc_id, source_rank FROM u ORDER BY source_rank, o, doc_id LIMIT 30""")
def hybrid_concat(spark: SparkSession, d: str) -> DataFrame:
    sem, kw = _parts(spark, d)
    a, b = sem.where("distance < 1.2").select("doc_id", F.col("distance").alias("o")), kw.select("doc_id", (-F.col("score")).alias("o"))
    return rank.concat_fusion(a, b, "doc_id", ["o", "doc_id"], 30).select("doc_id", "source_rank")


@query(f"""WITH {_BM25}, {_SEM}, {_KEY}, a AS (SELECT doc_id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS x FROM (SELECT doc_id, 1 - distance / 2 AS s FROM sem)),
b AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM kw)
SELECT doc_id, round(0.3::DOUBLE * coalesce(a.x, 0) + 0.7::DOUBLE * coalesce(b.x, 0), 6) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 10""")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    sem, kw = _parts(spark, d)
    got = rank.weighted(sem.select("doc_id", (1 - F.col("distance") / 2).alias("score")), kw, ["doc_id"], 0.3)
    return got.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT vec_id, round(1 - array_cosine_similarity(embedding::DOUBLE[64], q), 6) AS distance FROM embeddings, (SELECT embedding::DOUBLE[64] AS q FROM embeddings ORDER BY vec_id LIMIT 1) ORDER BY 2, 1 LIMIT 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    near = rank.knn(_t(spark, d, "embeddings"), _first_vector(spark, d), 20, ["vec_id"], metric="cosine")
    return near.select("vec_id", F.round("distance", 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


# The engine: an index of all documents, searched and changed

_INDEXES: dict[tuple[str, str], str] = {}


def _engine(spark: SparkSession, d: str, own: bool = False):
    """An engine with an index of ``documents``, built once a session and table, or anew for a query that changes it."""
    from .engine import Engine

    at = (spark.sparkContext.applicationId, d)
    if own or at not in _INDEXES:
        engine = Engine(spark, f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
        engine.build(_docs(spark, d).select("doc_id", "text", "source", F.col("source").alias("path")), vectors=False)
        if own:
            return engine
        _INDEXES[at] = engine.folder
    return Engine.open(spark, _INDEXES[at])


def _engine_sql(hit: str, terms: list[str], k: int, where: str = "TRUE") -> str:
    """BM25 over chunks with the statistics of all of them, for the chunks where ``hit`` holds."""
    tf = ", ".join(f"len(list_filter(tk, lambda w: w = '{t}'))::DOUBLE AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"(count(*) FILTER (WHERE t{i} > 0))::DOUBLE AS d{i}" for i in range(len(terms)))
    part = lambda i: f"ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
    return f"""WITH {_CHUNKS}, t AS (SELECT doc_id, source, chunk_id, {_TK} AS tk FROM chunks WHERE text <> ''),
f AS (SELECT doc_id, source, chunk_id, ' ' || array_to_string(tk, ' ') || ' ' AS j, len(tk)::DOUBLE AS dl, {tf} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM f)
SELECT doc_id, chunk_id, round({' + '.join(part(i) for i in range(len(terms)))}, 6) AS score FROM f, s WHERE ({hit}) AND ({where}) ORDER BY 3 DESC, 1, 2 LIMIT {k}"""


def _hits(engine, text: str, k: int, **more) -> DataFrame:
    from .engine import SearchQuery

    return engine.search(SearchQuery(text, mode="keyword", top_k=k, **more)).select("doc_id", "chunk_id", F.round("score", 6).alias("score"))


@query(_engine_sql("contains(j, ' of ') AND contains(j, ' the ') AND NOT contains(j, ' and ')", ["of", "the"], 25))
def engine_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_engine(spark, d), "the of NOT and", 25)


@query(_engine_sql("contains(j, ' of the ')", ["of", "the"], 25))
def engine_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_engine(spark, d), '"of the"', 25)


@query(_engine_sql("contains(j, ' eau ') OR contains(j, ' der ')", ["der", "eau"], 40))
def engine_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_engine(spark, d), "eau OR der", 40)


@query(_engine_sql("contains(j, ' the ')", ["the"], 25, "source IN ('src1', 'src3')"))
def engine_facets(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_engine(spark, d), "the", 25, sources=["src1", "src3"])


@query(_engine_sql("contains(j, ' the ') AND contains(j, ' thr')", ["the", "thr"], 25))
def engine_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_engine(spark, d), "the thr*", 25)


@query(f"WITH {_CHUNKS}, t AS (SELECT unnest(list_distinct({_TK})) AS term FROM chunks WHERE text <> '') SELECT term, count(*) AS df, levenshtein(term, 'place')::INT AS distance FROM t WHERE levenshtein(term, 'place') <= 2 GROUP BY ALL")
def engine_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The index's terms within two edits of a word, by the variants that they share with it."""
    return _engine(spark, d).fuzzy_terms("place", 2)


@query(_engine_sql("contains(j, ' of ') AND contains(j, ' the ') AND NOT contains(j, ' and ')", ["of", "the"], 25))
def engine_stream(spark: SparkSession, d: str) -> DataFrame:
    """An index that a stream of the documents' files feeds, searched."""
    from .engine import Engine

    run = f"{shared_folder(spark).rstrip('/')}/follow-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_docs(spark, d).schema).parquet(f"{d}/documents.parque[t]")
    engine = Engine(spark, f"{run}/index")
    engine.follow(stream.select("doc_id", "text", "source", F.col("source").alias("path")), f"{run}/log", vectors=False).awaitTermination()
    return _hits(engine, "the of NOT and", 25)


@query(f"""WITH documents AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'changed the text ' || text ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0),
{_CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE contains(' ' || array_to_string({_TK}, ' ') || ' ', ' the ')) AS n_hits FROM chunks WHERE text <> '' GROUP BY 1""")
def engine_update(spark: SparkSession, d: str) -> DataFrame:
    """An index whose documents are changed, taken out by an update and removed; then its chunks and hits by document."""
    engine = _engine(spark, d, own=True)
    docs = _docs(spark, d).select("doc_id", "source", F.col("source").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("changed the text "), "text")).otherwise(F.col("text")).alias("text"))
    engine.update(docs.where("doc_id % 3 <> 0"))
    engine.remove(docs.where("doc_id % 11 = 0"))
    hits = engine._index(engine._now()).search(match.parse("the")).groupBy("doc_id").agg(F.count("*").alias("n_hits"))
    own = engine.chunks().groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return own.join(hits, "doc_id", "left").select("doc_id", "n_chunks", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


# Facets, groups, sets


@query("SELECT doc_id, source FROM documents WHERE list_has_any([lang, source], ['fr', 'src3'])")
def facet_any_tag(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("tags", F.array("lang", "source")).where(facets.any_of("tags", ["fr", "src3"])).select("doc_id", "source")


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year FROM orders) SELECT o_orderkey, year FROM o WHERE year IS NULL OR year BETWEEN 1996 AND 1997")
def facet_year_range(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", year.alias("year")).where(facets.year_between(F.col("year"), 1996, 1997))


@query("SELECT (SELECT list(DISTINCT lang ORDER BY lang) FROM documents) AS tags, (SELECT list(DISTINCT source ORDER BY source) FROM documents) AS collections, (SELECT min(length(text))::INT FROM documents) AS year_min, (SELECT max(length(text))::INT FROM documents) AS year_max")
def filter_options(spark: SparkSession, d: str) -> DataFrame:
    return facets.filter_options(_docs(spark, d).select(F.array("lang").alias("tags"), F.array("source").alias("collections"), F.length("text").alias("year")))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '1998-06-01' - INTERVAL 12 MONTH AND o_orderdate::DATE <= DATE '1998-06-01'""")
def date_preset(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").where(facets.within_months(F.to_date("o_orderdate"), 12, "1998-06-01")).select("o_orderkey")


@query(f"""WITH {_CHUNKS}, h AS (SELECT source AS path, doc_id * 100000 + chunk_id AS ord, length(text)::DOUBLE AS score FROM chunks WHERE text <> ''),
g AS (SELECT path, min(ord) AS first, count(*) AS n_hits, avg(score) AS a FROM h GROUP BY path)
SELECT path, first, n_hits, round(a, 6) AS avg_score, row_number() OVER (ORDER BY first, path)::INT AS rank FROM g""")
def group_by_path(spark: SparkSession, d: str) -> DataFrame:
    hits = C.chunk(_docs(spark, d).select("doc_id", F.col("source").alias("path"), "text"))
    hits = hits.select("path", (F.col("doc_id") * 100000 + F.col("chunk_id")).alias("ord"), F.length("chunk_text").cast("double").alias("score"))
    return facets.group_hits(hits).withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id)::INT AS rank_in_group FROM documents QUALIFY rank_in_group <= 5")
def top5_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("source", "doc_id", F.length("text").alias("n"))
    return facets.top_per_group(rows, "source", [F.desc("n"), F.col("doc_id")]).select("source", "doc_id", "rank_in_group")


@query("SELECT o_custkey, greatest(count(*) - 3, 0) AS more FROM orders GROUP BY 1")
def group_overflow(spark: SparkSession, d: str) -> DataFrame:
    return facets.overflow(_t(spark, d, "orders"), "o_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def live_items_anti(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS side FROM documents")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    ids = _docs(spark, d).select("doc_id")
    return facets.merge_sources(ids.withColumn("side", F.lit("old")), ids.where("doc_id % 3 = 0").withColumn("side", F.lit("new")), "doc_id")


@query("SELECT sha1(text) AS sha1, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_sha1(spark: SparkSession, d: str) -> DataFrame:
    return facets.dedup_content(_docs(spark, d))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_name)::INT AS r FROM customer QUALIFY r <= 50")
def sort_unknown_last(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("bal"))
    top = facets.sort_hits(rows, "bal", ascending=False, tie="c_name").limit(50)
    return top.select("c_custkey", F.row_number().over(W.orderBy(F.col("bal").desc_nulls_last(), "c_name")).alias("r"))


# Library


def _library(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Part, lineitem, supplier, customer and nation in the shape of a library: parts are items, orders their creators' order."""
    part, line, supp = _t(spark, d, "part"), _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    names = F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("p_brand", "p_type"))).alias("fieldID", "value")
    data = part.select(F.col("p_partkey").alias("itemID"), names)
    value = (F.col("itemID") * 10 + F.col("fieldID")).alias("valueID")
    return {
        "items": part.select(F.col("p_partkey").alias("itemID"), F.col("p_size").alias("itemTypeID"), F.lit("2020").alias("dateAdded"), F.lit("2021").alias("dateModified"), F.concat(F.lit("K"), "p_partkey").alias("key")),
        "deletedItems": part.where("p_size % 10 = 0").select(F.col("p_partkey").alias("itemID")),
        "itemData": data.select("itemID", "fieldID", value),
        "itemDataValues": data.select(value, "value"),
        "fields": spark.sql("SELECT * FROM VALUES (1, 'brand'), (2, 'type') AS t(fieldID, fieldName)"),
        "itemCreators": line.groupBy(F.col("l_partkey").alias("itemID"), F.col("l_suppkey").alias("creatorID")).agg(F.min("l_linenumber").alias("orderIndex")),
        "creators": supp.select(F.col("s_suppkey").alias("creatorID"), F.lit(None).cast("string").alias("firstName"), F.col("s_name").alias("lastName")),
        "itemTags": line.select(F.col("l_partkey").alias("itemID"), F.ascii("l_returnflag").cast("long").alias("tagID")).distinct(),
        "tags": line.select(F.ascii("l_returnflag").cast("long").alias("tagID"), F.col("l_returnflag").alias("name")).distinct(),
        "collectionItems": line.select(F.ascii("l_linestatus").cast("long").alias("collectionID"), F.col("l_partkey").alias("itemID")).distinct(),
        "collections": line.select(F.ascii("l_linestatus").cast("long").alias("collectionID"), F.col("l_linestatus").alias("collectionName")).distinct(),
        "itemAttachments": part.select((F.col("p_partkey") + 1_000_000).alias("itemID"), F.col("p_partkey").alias("parentItemID"), F.lit(None).cast("string").alias("path"), F.lit("").alias("contentType")),
        "itemNotes": part.where("p_size % 3 = 0").select((F.col("p_partkey") + 2_000_000).alias("itemID"), F.col("p_partkey").alias("parentItemID"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("note")),
    }


@query("SELECT p_partkey AS itemID, p_brand AS brand, p_type AS type FROM part")
def eav_pivot_map(spark: SparkSession, d: str) -> DataFrame:
    return library.metadata(_library(spark, d)).select("itemID", F.col("metadata")["brand"].alias("brand"), F.col("metadata")["type"].alias("type"))


_CREATORS = "cr AS (SELECT l_partkey AS k, string_agg(s_name, '|' ORDER BY o, l_suppkey) AS creators FROM (SELECT l_partkey, l_suppkey, min(l_linenumber) AS o FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"


@query(f"WITH {_CREATORS} SELECT k AS itemID, creators FROM cr")
def ordered_creators(spark: SparkSession, d: str) -> DataFrame:
    return library.creators(_library(spark, d)).select("itemID", F.array_join("creators", "|").alias("creators"))


@query(f"""WITH {_CREATORS}, tg AS (SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS tags, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS collections FROM lineitem GROUP BY 1)
SELECT 'library:' || p_partkey AS doc_id, p_brand AS brand, coalesce(creators, '') AS creators, coalesce(tags, '') AS tags, coalesce(collections, '') AS collections,
CASE WHEN p_size % 3 = 0 THEN '<p>' || p_name || '</p>' ELSE '' END AS notes FROM part LEFT JOIN cr ON k = p_partkey LEFT JOIN tg ON tg.k = p_partkey WHERE p_size % 10 <> 0""")
def assemble_item(spark: SparkSession, d: str) -> DataFrame:
    got = library.items(_library(spark, d))
    return got.select("doc_id", F.col("metadata")["brand"].alias("brand"), *[F.array_join(c, "|").alias(c) for c in ("creators", "tags", "collections", "notes")])


@query("SELECT 'library:' || p_partkey AS doc_id, p_name AS text FROM part WHERE p_size % 3 = 0 AND p_size % 10 <> 0")
def library_documents(spark: SparkSession, d: str) -> DataFrame:
    return library.documents(library.items(_library(spark, d))).select("doc_id", "text")


@query(f"""WITH {_CREATORS} SELECT 'library:' || p_partkey AS doc_id,
regexp_replace(lower(coalesce(list_last(string_split(string_split(creators, '|')[1], ' ')), 'anon')), '[^\\p{{L}}\\p{{N}}]', '', 'g') || 'nd_' || p_partkey AS citekey FROM part LEFT JOIN cr ON k = p_partkey WHERE p_size % 10 <> 0""")
def bibtex_export(spark: SparkSession, d: str) -> DataFrame:
    return library.bibtex(library.items(_library(spark, d))).select("doc_id", "citekey")


# Thesaurus


def _tags_sql() -> str:
    rows = ", ".join(f"('{c}', '{' '.join(match.split_words(t))}')" for c, s in THESAURUS.items() for t in [c, *s])
    return f"o(concept, term) AS (VALUES {rows}), j AS (SELECT doc_id, {_JOINED} AS j FROM documents), tagged AS (SELECT DISTINCT doc_id, concept FROM j, o WHERE contains(j, ' ' || term || ' '))"


@query(f"WITH {_tags_sql()} SELECT doc_id, concept FROM tagged")
def concept_tagging(spark: SparkSession, d: str) -> DataFrame:
    return thesaurus.tag(_docs(spark, d), THESAURUS, "doc_id")


@query(f"WITH {_tags_sql()} SELECT a.concept AS concept_a, b.concept AS concept_b, count(*) AS n_docs FROM tagged a JOIN tagged b USING (doc_id) WHERE a.concept < b.concept GROUP BY ALL")
def concept_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return facets.cooccurrence(thesaurus.tag(_docs(spark, d), THESAURUS, "doc_id"), "doc_id", "concept")


@query("""WITH RECURSIVE t AS (SELECT p_partkey, p_type, string_split(p_type, ' ') AS w FROM part),
edges AS (SELECT DISTINCT p_type AS narrower, array_to_string(w[2:], ' ') AS broader FROM t WHERE len(w) > 1 UNION SELECT DISTINCT array_to_string(w[2:], ' '), array_to_string(w[3:], ' ') FROM t WHERE len(w) > 2),
up AS (SELECT narrower AS concept, narrower AS ancestor, 0 AS steps FROM edges UNION SELECT broader, broader, 0 FROM edges UNION SELECT u.concept, e.broader, u.steps + 1 FROM up u JOIN edges e ON u.ancestor = e.narrower),
pairs AS (SELECT DISTINCT a.p_type AS concept_a, b.p_type AS concept_b FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1),
met AS (SELECT p.*, x.ancestor, x.steps + y.steps AS path FROM pairs p JOIN up x ON x.concept = p.concept_a JOIN up y ON y.concept = p.concept_b AND y.ancestor = x.ancestor),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY concept_a, concept_b ORDER BY path, ancestor) = 1)
SELECT p.concept_a, p.concept_b, b.ancestor, b.path::INT AS path, coalesce(1.0::DOUBLE / (1 + b.path), 0.0::DOUBLE) AS similarity FROM pairs p LEFT JOIN best b USING (concept_a, concept_b)""")
def concept_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How near the types of neighbouring parts are in the hierarchy that the words of types make: the fewer words, the broader."""
    part = _t(spark, d, "part").select("p_partkey", "p_type")
    words = F.split("p_type", " ")
    tail = lambda n: F.array_join(F.slice(words, n + 1, F.size(words)), " ")
    edges = part.where(F.size(words) > 1).select(F.col("p_type").alias("narrower"), tail(1).alias("broader"))
    edges = edges.union(part.where(F.size(words) > 2).select(tail(1), tail(2))).distinct()
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("concept_b"))
    pairs = part.withColumnRenamed("p_type", "concept_a").join(after, "p_partkey")
    return thesaurus.similarity(pairs, edges)


@query(f"SELECT item_id FROM benchmark WHERE contains({_JOINED}, ' in the ') OR contains({_JOINED}, ' dans ') OR contains({_JOINED}, ' heit ') OR contains({_JOINED}, ' para ') OR contains({_JOINED}, ' place ')")
def ontology_expand_match(spark: SparkSession, d: str) -> DataFrame:
    node = match.parse(thesaurus.expand_query("place", THESAURUS))
    return _t(spark, d, "benchmark").where(match.compile_match(node, T.tokens(F.col("text")))).select("item_id")


# Change detection


@query("""WITH k AS (SELECT source, doc_id::VARCHAR || ':' || md5(text) AS key FROM documents),
f AS (SELECT source, substring(md5(key), 1, 3) AS p, md5(string_agg(key, '|' ORDER BY key)) AS d FROM k GROUP BY ALL)
SELECT source, md5(string_agg(d, '' ORDER BY p)) AS digest FROM f GROUP BY 1""")
def source_digest(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import digest

    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))
    return digest(_docs(spark, d).select("source", key.alias("key")), ["source"])


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (doc_id)""")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import diff

    rows = _docs(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha1"))
    new = rows.where("doc_id % 3 <> 0").withColumn("sha1", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha1")))
    return diff(rows.where("doc_id % 5 <> 0"), new, key="doc_id")


@query("SELECT count(*) AS n_chunks, count(DISTINCT sha1) AS n_contents FROM (SELECT sha1(text) AS sha1, unnest(range(0, length(text), 250)) AS st, text FROM (SELECT DISTINCT text FROM documents)) WHERE trim(substring(text, st + 1, 300)) <> ''")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import watch_documents

    run = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = _docs(spark, d).schema
    watch_documents(spark, f"{d}/documents.parque[t]", schema, f"{run}/out", f"{run}/log").awaitTermination()
    return spark.read.parquet(f"{run}/out").agg(F.count("*").alias("n_chunks"), F.countDistinct("sha1").alias("n_contents"))


# Whole-text functions without SQL counterpart


@query()
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Marked windows of the matching chunks; tests compare them with a brute-force version."""
    node = match.parse('"of the" OR eau')
    chunks = C.chunk(_docs(spark, d).select("doc_id", "text"))
    hits = chunks.where(match.compile_match(node, T.tokens(F.col("chunk_text"))))
    return hits.select("doc_id", "chunk_id", match.snippet(F.col("chunk_text"), node).alias("snippet"))


@query()
def summarise_extractive(spark: SparkSession, d: str) -> DataFrame:
    """The three most telling sentences of every document."""
    from pyspark.sql import types as types

    @F.pandas_udf(types.StringType())
    def run(texts):
        import pandas as pd

        return pd.Series([facets.summarise(t or "") for t in texts])

    return _docs(spark, d).select("doc_id", run("text").alias("summary"))

