"""Queries over the index: postings, keyword, vector and hybrid search, deduplication. Each has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.operators import index as I
from pagewright.operators import ingest, reports
from pagewright.operators import vectors as V
from pagewright.operators.rows import page_of
from pagewright.plans.joins import checked_join
from pagewright.plans.runtime import materialize, scratch_path, spread, table
from pagewright.plans.scalar_queries import WS, with_normal_url
from pagewright.sources.files import write_postings

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _terms(expr: str) -> str:
    return f"SELECT doc_idx, unnest(list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '{WS}+'), lambda w: length(w) > 2)) AS term FROM search_index"


def _postings(expr: str) -> str:
    return f"SELECT term, doc_idx, count(*) AS tf FROM ({_terms(expr)}) GROUP BY ALL"


@query(_postings("title"))
def inverted_index_title(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(table(spark, d, "search_index"), "doc_idx", "title")


@query(f"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM ({_postings('substring(content, 1, 500)')}) GROUP BY 1")
def inverted_index_content500(spark: SparkSession, d: str) -> DataFrame:
    return I.dictionary(I.postings(table(spark, d, "search_index"), "doc_idx", "content", 500))


@query(f"""SELECT (SELECT count(*) FROM search_index) AS docs, (SELECT count(DISTINCT lower(coalesce(domain, ''))) FROM search_index) AS domains,
    (SELECT count(DISTINCT term) FROM ({_terms('title')})) AS title_terms, (SELECT count(DISTINCT term) FROM ({_terms('substring(content, 1, 500)')})) AS content_terms""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_index")
    a = docs.agg(F.count("*").alias("docs"), F.count_distinct(F.lower(F.coalesce("domain", F.lit("")))).alias("domains"))
    t = I.postings(docs, "doc_idx", "title").agg(F.count_distinct("term").alias("title_terms"))
    c = I.postings(docs, "doc_idx", "content", 500).agg(F.count_distinct("term").alias("content_terms"))
    return a.crossJoin(t).crossJoin(c)  # one row each


@query("SELECT DISTINCT lower(domain) AS domain FROM search_index WHERE domain <> '' ORDER BY 1")
def domain_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_index").filter("domain <> ''").select(F.lower("domain").alias("domain")).distinct().orderBy("domain")


def _hits(terms: list[str], domain: str | None = None) -> str:
    t = "[" + ", ".join(f"'{x}'" for x in terms) + "]"
    where = f"AND ((SELECT count(*) FROM search_index WHERE lower(domain) = '{domain}') = 0 OR lower(domain) = '{domain}')" if domain else ""
    score = " + ".join(f"CAST(contains(lower(coalesce(title, '')), '{x}') AS INT)" for x in terms)
    return f"""SELECT doc_idx, url, title, {score} AS score FROM search_index
      WHERE list_has_all(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '{WS}+'), lambda w: length(w) > 2), {t}) {where} ORDER BY score DESC, doc_idx"""


@query(_hits(["and", "the"]) + " LIMIT 10")
def search_and_title(spark: SparkSession, d: str) -> DataFrame:
    return I.search(table(spark, d, "search_index"), "the and").select("doc_idx", "url", "title", "score")


@query(_hits(["the"], "mossfenjournal.example") + " LIMIT 10")
def search_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return I.search(table(spark, d, "search_index"), "the", domain="mossfenjournal.example").select("doc_idx", "url", "title", "score")


@query(_hits(["the"], "nosuch.example") + " LIMIT 10")
def search_unknown_domain(spark: SparkSession, d: str) -> DataFrame:
    return I.search(table(spark, d, "search_index"), "the", domain="nosuch.example").select("doc_idx", "url", "title", "score")


@query(_hits(["notes"]) + " LIMIT 10 OFFSET 20")
def search_pagination(spark: SparkSession, d: str) -> DataFrame:
    return I.search(table(spark, d, "search_index"), "notes", page=3).select("doc_idx", "url", "title", "score")


@query(f"SELECT 'notes' AS query, count(*) AS total_results, 3 AS page, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages, 'strict_and' AS search_type FROM ({_hits(['notes'])})")
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.search_summary(table(spark, d, "search_index"), "notes", page=3)


@query(f"SELECT key, first(url ORDER BY doc_idx) AS url, min(doc_idx) AS doc_idx, count(*) AS n FROM ({with_normal_url('search_index', 'doc_idx, url')}) WHERE key <> '' GROUP BY key")
def dedup_url_api(spark: SparkSession, d: str) -> DataFrame:
    keyed = spread(table(spark, d, "search_index").select("doc_idx", "url")).select("doc_idx", "url", U.normalize(F.col("url")).alias("key")).filter("key <> ''")
    first = keyed.groupBy("key").agg(F.min_by("url", "doc_idx").alias("url"), F.min("doc_idx").alias("doc_idx"), F.count("*").alias("n"))
    return first.select("key", "url", "doc_idx", "n")


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(url, chr(0))) AS kept, count(*) - count(DISTINCT coalesce(url, chr(0))) AS removed FROM search_index")
def dedup_index_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dedup_report(table(spark, d, "search_index"), "url")


@query("SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_text_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Texts are grouped by hash, and only the few rows that go are joined back: no text is shuffled while these fit a checked broadcast."""
    texts = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    copies = checked_join(hashed, materialize(first, "dedup-first"), ["h"], "inner", "doc_id").filter("doc_id <> first").select("doc_id")
    return checked_join(texts, materialize(copies, "dedup-copies"), ["doc_id"], "left_anti", "doc_id")


def _index_on(spark: SparkSession, d: str) -> DataFrame:
    """The written index of titles: clustered and sorted by term."""
    path = scratch_path(spark, "postings")
    write_postings(I.postings(table(spark, d, "search_index"), "doc_idx", "title"), path)
    return spark.read.parquet(path)


@query(_hits(["and", "the"]) + " LIMIT 10")
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctive search by intersecting the postings of a written index, then looking up the documents."""
    docs = table(spark, d, "search_index")
    hits = I.score(I.matching_by_index(_index_on(spark, d), docs, "the and", "doc_idx"), "the and")
    return page_of(hits, [F.desc("score"), F.asc("doc_idx")], 1, 10).select("doc_idx", "url", "title", "score")


@query(f"SELECT doc_idx FROM ({_postings('substring(content, 1, 500)')}) WHERE term IN ('the', 'and') GROUP BY doc_idx HAVING count(*) = 2")
def search_content_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose indexed content holds all terms, from the content postings."""
    docs = table(spark, d, "search_index")
    return I.matching_by_index(I.postings(docs, "doc_idx", "content", 500), docs.select("doc_idx"), "the and", "doc_idx")


@query(_postings("substring(content, 1, 500)"))
def postings_content500(spark: SparkSession, d: str) -> DataFrame:
    """The content postings themselves."""
    return I.postings(table(spark, d, "search_index"), "doc_idx", "content", 500)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first().embedding  # one vector


_SEM = "SELECT e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id, round(s, 6) AS semantic_score FROM ({_SEM}) ORDER BY s DESC, vec_id LIMIT 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    top = V.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 20)
    return top.select("vec_id", F.round("semantic_score", 6).alias("semantic_score"))


def _semantic_docs(spark: SparkSession, d: str, k: int) -> DataFrame:
    top = V.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), k)
    return top.join(table(spark, d, "search_index").select(F.col("doc_idx").alias("vec_id"), "url"), "vec_id")


_KEY30 = f"SELECT url FROM ({_hits(['notes'])} LIMIT 30)"
_SEM30 = f"SELECT i.url, max(s) AS s FROM (SELECT * FROM ({_SEM}) ORDER BY s DESC, vec_id LIMIT 30) t JOIN search_index i ON i.doc_idx = t.vec_id GROUP BY i.url"


@query(f"""SELECT url, round(h, 6) AS hybrid_score, origin FROM (
    SELECT k.url, coalesce(s.s, 0) * 0.3 AS h, 'keyword' AS origin FROM (SELECT DISTINCT url FROM ({_KEY30})) k LEFT JOIN ({_SEM30}) s USING (url)
    UNION ALL SELECT s.url, s.s * 0.7, 'semantic' FROM ({_SEM30}) s ANTI JOIN ({_KEY30}) k USING (url)) ORDER BY h DESC, url LIMIT 10""")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    keyword = I.search(table(spark, d, "search_index"), "notes", limit=30)
    out = V.hybrid(keyword, _semantic_docs(spark, d, 30), 10)
    return out.select("url", F.round("hybrid_score", 6).alias("hybrid_score"), "origin")


_BASIC = f"SELECT url, doc_idx AS pos, 0 AS src FROM ({_hits(['harpsichord', 'notes'])} LIMIT 10)"
_SEMPOS = f"SELECT i.url, row_number() OVER (ORDER BY t.s DESC, t.vec_id) AS pos, 1 AS src FROM (SELECT * FROM ({_SEM}) ORDER BY s DESC, vec_id LIMIT 20) t JOIN search_index i ON i.doc_idx = t.vec_id"
_BOTH = f"(SELECT * FROM ({_BASIC}) UNION ALL SELECT * FROM ({_SEMPOS}) WHERE (SELECT count(*) FROM ({_BASIC})) < 8)"


@query(f"""SELECT url, src, pos FROM (SELECT key, first(url ORDER BY src, pos, url) AS url, first(src ORDER BY src, pos, url) AS src, first(pos ORDER BY src, pos, url) AS pos
    FROM ({with_normal_url(_BOTH, 'url, src, pos')}) WHERE key <> '' GROUP BY key) ORDER BY src, pos LIMIT 10""")
def semantic_fallback_merge(spark: SparkSession, d: str) -> DataFrame:
    basic = I.search(table(spark, d, "search_index"), "notes harpsichord").select("url", F.col("doc_idx").alias("pos"))
    sem = _semantic_docs(spark, d, 20)
    from pyspark.sql import Window

    ranked = sem.select("url", F.row_number().over(Window.orderBy(F.desc("semantic_score"), "vec_id")).cast("long").alias("pos"))  # 20 rows
    return V.fallback_merge(basic, ranked, 10)




def _protos_sql(own: bool) -> str:
    where = "" if own else "WHERE v.vec_id <> p.vec_id"
    return f"""SELECT vec_id, max(CASE WHEN label % 2 = 1 THEN s END) AS personal, max(CASE WHEN label % 2 = 0 THEN s END) AS corporate FROM (
      SELECT v.vec_id, p.label, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS s
      FROM embeddings v, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100) p {where}) GROUP BY 1"""


def _prototypes(spark: SparkSession, d: str) -> DataFrame:
    # the first vectors play the labelled prototypes
    return table(spark, d, "embeddings").orderBy("vec_id").limit(100).select("vec_id", "embedding", (F.col("label") % 2).alias("label"))


@query(f"""SELECT vec_id, CASE WHEN greatest(personal, corporate) >= 0.3 THEN CAST(personal > corporate AS INT) END AS prediction, round(greatest(personal, corporate), 6) AS confidence
    FROM ({_protos_sql(True)})""")
def prototype_classify(spark: SparkSession, d: str) -> DataFrame:
    m = V.class_maxima(table(spark, d, "embeddings"), _prototypes(spark, d))
    r = m.select("vec_id", V.prototype_decision(F.col("personal"), F.col("corporate"), 0.3).alias("r"))
    return r.select("vec_id", "r.prediction", F.round("r.confidence", 6).alias("confidence"))


@query(f"""SELECT round(avg(CASE WHEN greatest(personal, corporate) >= 0.1 AND CAST(personal > corporate AS INT) = label % 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
    FROM ({_protos_sql(False)}) JOIN (SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100) USING (vec_id)""")
def prototype_eval(spark: SparkSession, d: str) -> DataFrame:
    protos = _prototypes(spark, d)
    m = V.class_maxima(protos, protos, leave_one_out=True).join(protos.select("vec_id", "label"), "vec_id")
    hit = F.coalesce((V.prototype_decision(F.col("personal"), F.col("corporate"), 0.1)["prediction"] == F.col("label")).cast("double"), F.lit(0.0))
    return m.agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count("*").alias("n"))


_A, _B = f"SELECT DISTINCT url FROM ({_hits(['notes'])} LIMIT 50)", f"SELECT DISTINCT url FROM ({_hits(['from', 'notes'])} LIMIT 50)"


@query(f"""SELECT *, CASE WHEN greatest(first, second) > 0 THEN round(100.0 * common / greatest(first, second), 2) ELSE 0 END AS overlap_pct,
    CASE WHEN common = greatest(first, second) AND common > 0 THEN 'identical' WHEN 100.0 * common / greatest(first, second) >= 50 THEN 'similar' ELSE 'different' END AS verdict
    FROM (SELECT (SELECT count(*) FROM ({_A})) AS first, (SELECT count(*) FROM ({_B})) AS second, (SELECT count(*) FROM (({_A}) INTERSECT ({_B}))) AS common)""")
def search_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "search_index")
    return reports.overlap(I.search(docs, "notes", limit=50), I.search(docs, "notes from", limit=50))
