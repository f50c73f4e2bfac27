"""Retrieval and mapping queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import values as V
from granary.operators import retrieval as R
from granary.operators import sequences as S
from granary.sources.tables import read_table

TERMS = ("선량", "초음파", "조영", "격자", "에너지")
FIELDS = {"content": 0.35, "scope_text": 1.0}
SCOPE = ("mapped_period", "mapped_subject", "mapped_field", "mapped_area", "mapped_detail")


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    scope = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in SCOPE])
    rows = read_table(spark, d, "chunks").withColumn("scope_text", scope)
    return rows.select("doc_id", "rag_input_id", "content", "scope_text", "mapped_subject", "mapped_area", "scope_mapping_confidence").filter("trim(content) <> ''")


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q", t) for t in TERMS], "query string, term string")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = R.bm25(_indexed(spark, d), "doc_id", FIELDS, _terms(spark)).select("query", "id", F.round("score", 6).alias("score"))
    return R.top(scored, ["query"], [F.asc("score"), F.asc("id")], 20).select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _indexed(spark, d)
    scored = R.bm25(rows, "doc_id", FIELDS, _terms(spark)).select("query", "id", F.round("score", 6).alias("score"))
    kept = rows.filter((F.col("mapped_subject") == "영상검사학") & F.col("scope_mapping_confidence").isin("high", "medium")).select(F.col("doc_id").alias("id"))
    return R.top(scored.join(kept, "id", "left_semi"), ["query"], [F.asc("score"), F.asc("id")], 20).select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_area_eval(spark: SparkSession, d: str) -> DataFrame:
    """Each area's name as a query: pass if the first hit has the area, warn if one of five has, else fail."""
    areas = read_table(spark, d, "exam_scope").select("area").distinct()
    queries = areas.select(F.col("area").alias("query"), F.explode(R.index_terms(F.col("area"))).alias("term"))
    rows = _indexed(spark, d)
    scored = R.bm25(rows, "doc_id", FIELDS, queries).select("query", "id", F.round("score", 6).alias("score"))
    hits = R.top(scored, ["query"], [F.asc("score"), F.asc("id")], 5).join(rows.select(F.col("doc_id").alias("id"), "mapped_area"), "id")
    same = F.coalesce(F.col("mapped_area") == F.col("query"), F.lit(False))
    judged = hits.groupBy("query").agg(F.max(same & (F.col("rank") == 1)).alias("first"), F.max(same).alias("any"))
    return judged.select("query", F.when(F.col("first"), "pass").when(F.col("any"), "warn").otherwise("fail").alias("verdict"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return R.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 10)


LEVELS = ("mapped_subject", "mapped_field", "mapped_area", "mapped_detail")


def _placed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the scope and text of the chunk of the same number."""
    chunks = read_table(spark, d, "chunks").select(F.col("doc_id").cast("bigint").alias("vec_id"), *LEVELS, F.concat_ws(" ", "content", "excerpt", "metadata_json").alias("text")).dropDuplicates(["vec_id"])
    return read_table(spark, d, "embeddings").select("vec_id", "embedding").join(chunks, "vec_id", "left")


def vector_progressive(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by scope from detail to area, field, subject and all; scores raised by the terms of the query's detail."""
    rows = _placed_vectors(spark, d).withColumn("_n", F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))))
    q = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"), F.col("_n").alias("_qn"), X.boost_terms(F.col("mapped_detail")).alias("terms"), *[F.col(c).alias(f"_{c}") for c in LEVELS])
    pairs = rows.join(R.small(q), F.col("vec_id") != F.col("query_id"))
    score = R.dot(F.col("_q"), F.col("embedding")) / (F.col("_qn") * F.col("_n"))
    level = R.level_of([F.col(c) for c in LEVELS], [F.col(f"_{c}") for c in LEVELS])
    scored = pairs.select("query_id", F.col("vec_id").alias("id"), level.alias("level"), F.round(V.boosted(score, F.coalesce("text", F.lit("")), F.col("terms")), 6).alias("score"))
    return R.progressive(scored, "query_id", "id", "level", "score", 6)


def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of each query; a vector met twice counts at the first query; of all these the forty best."""
    rows = read_table(spark, d, "embeddings")
    hits = R.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5)
    once = S.first_per_key(hits, ["id"], [F.asc("query_id"), F.asc("rank")]).select("id", "query_id", "score")
    return once.orderBy(F.desc("score"), F.asc("id")).limit(40)


def scored_scope_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against their subject's scope rows: 8 for the detail, 3 for the area, 1.25 a name found (to 8), 0.75 a word (to 6).

    Words are met by an equal join; only names, which stand inside other words too, meet every scope row of the subject.
    """
    chunks = read_table(spark, d, "chunks").select("rag_input_id", "mapped_subject", "content").filter("content is not null").dropDuplicates(["rag_input_id"])
    scope = read_table(spark, d, "exam_scope").select("id", "subject", X.without_numbering(X.nfc("detail")).alias("detail"), X.without_numbering(X.nfc("area")).alias("area"))
    named = chunks.select("rag_input_id", "mapped_subject", X.compact_key(F.col("content")).alias("k"))
    keys = scope.select("id", F.col("subject").alias("mapped_subject"), X.compact_key(F.col("detail")).alias("dk"), X.compact_key(F.col("area")).alias("ak"))
    hits = named.join(R.small(keys), "mapped_subject").select("rag_input_id", "id", (F.contains("k", "dk") & (F.col("dk") != "")).alias("d"), (F.contains("k", "ak") & (F.col("ak") != "")).alias("a"))
    names = F.col("d").cast("int") + F.when(F.col("a"), 1).otherwise(0)
    by_name = hits.filter("d or a").select("rag_input_id", "id", (F.when(F.col("d"), 8.0).otherwise(0.0) + F.when(F.col("a"), 3.0).otherwise(0.0) + V.capped(names, 1.25, 8.0)).alias("score"))
    words = chunks.select("rag_input_id", "mapped_subject", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("word"))
    of_scope = scope.select("id", F.col("subject").alias("mapped_subject"), F.explode(F.array_distinct(X.tokens(F.concat_ws(" ", "detail", "area")))).alias("word"))
    met = words.join(R.small(of_scope), ["mapped_subject", "word"]).groupBy("rag_input_id", "id").agg(V.capped(F.count("*"), 0.75, 6.0).alias("score"))
    total = by_name.unionByName(met).groupBy("rag_input_id", "id").agg(F.sum("score").alias("score"))
    best = total.groupBy("rag_input_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    mapped = best.select("rag_input_id", F.col("b.id").alias("scope_id"), (-F.col("b.s")).alias("score"))
    return mapped.withColumn("confidence", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 5, "medium").otherwise("area_only"))


def range_join_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each source chunk with the scope detail of its area whose listed pages, from one list entry to the next, hold its page.

    The ranges are those between the list's own source pages; of overlapping ones the first by page and id wins.
    """
    from pyspark.sql import Window

    listed = read_table(spark, d, "exam_scope").select("area", "source_page", "id")
    pages = listed.groupBy("area", "source_page").agg(F.min("id").alias("scope_id"))
    ranges = pages.withColumn("until", F.coalesce(F.lead("source_page").over(Window.partitionBy("area").orderBy("source_page")), F.lit(1 << 30)))
    rows = read_table(spark, d, "source_chunk").select("id", "area", "page_start").distinct()
    hit = rows.join(R.small(ranges), (rows.area == ranges.area) & (F.col("page_start") >= F.col("source_page")) & (F.col("page_start") < F.col("until")), "left")
    return hit.groupBy(rows.id).agg(F.min_by("scope_id", F.struct("source_page", "scope_id")).alias("scope_id"))


def override_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Overrides by file, and by page where they name one, take precedence over the mapping; the first in the list wins.

    Each document of the store is an override for the files named like it: its low pages, then the file as a whole.
    """
    store = read_table(spark, d, "source_document").filter("filename <> ''").select("id", "filename", "area", F.from_json("low_text_pages", "array<int>").alias("low"))
    paged = store.select("id", "filename", F.explode("low").alias("page"), F.lit("low page").alias("to"))
    whole = store.filter("area is not null").select("id", "filename", F.lit(None).cast("int").alias("page"), F.col("area").alias("to"))
    rules = paged.unionByName(whole).withColumn("at", F.struct(F.when(F.col("page").isNull(), 1).otherwise(0).alias("kind"), "id"))
    rows = read_table(spark, d, "chunks").select("rag_input_id", "source_file", "page_or_slide", "mapped_area").distinct()
    hit = rows.join(R.small(rules), (F.col("source_file") == F.col("filename")) & (F.col("page").isNull() | (F.col("page") == F.col("page_or_slide"))), "left")
    first = hit.groupBy("rag_input_id", "mapped_area").agg(F.min_by("to", "at").alias("to"))
    return first.select("rag_input_id", F.coalesce("to", "mapped_area", F.lit("none")).alias("area"), F.col("to").isNotNull().alias("overridden"))


def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Stem words that the candidate's scope detail shares and lacks."""
    c = read_table(spark, d, "question_bank_candidate").select("id", F.array_distinct(X.tokens(F.col("stem"))).alias("s"), F.array_distinct(X.tokens(F.col("detail"))).alias("t")).dropna()
    return c.select("id", F.size(F.array_intersect("s", "t")).alias("shared"), F.size(F.array_except("t", "s")).alias("lacking")).distinct()


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered, bm25_area_eval, vector_topk, vector_progressive, multi_query_merge, scored_scope_mapping, range_join_detail, override_precedence, term_overlap)}

_ALL = "regexp_extract_all(lower({0}), '[0-9a-z가-힣]+')"
_BM25 = """
    i AS (SELECT doc_id, any_value(content) AS content, any_value(concat_ws(' ', {scope})) AS scope_text, any_value(mapped_subject) AS mapped_subject, any_value(mapped_area) AS mapped_area, any_value(scope_mapping_confidence) AS conf
          FROM chunks WHERE trim(content, ' ') <> '' GROUP BY doc_id),
    w AS (SELECT doc_id, {c} AS a, {s} AS b, mapped_subject, mapped_area, conf FROM i),
    g AS (SELECT count(*) AS docs, avg(len(a) + len(b)) AS mean FROM w),
    e AS (SELECT doc_id, len(a) + len(b) AS dl, unnest(a) AS term, 0.35 AS wt FROM w UNION ALL SELECT doc_id, len(a) + len(b), unnest(b), 1.0 FROM w),
    h AS (SELECT doc_id, dl, term, CAST(sum(wt) AS DOUBLE) AS f FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    r AS (SELECT term, CASE WHEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((docs - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf, mean FROM h, g GROUP BY term, docs, mean),
    z AS (SELECT query, doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM h JOIN r USING (term) JOIN q USING (term) GROUP BY query, doc_id)
""".format(scope=", ".join(f"nullif(trim({c}, ' '), '')" for c in SCOPE), c=_ALL.format("content"), s=_ALL.format("scope_text"))
_Q = "WITH q AS (SELECT 'q' AS query, unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term)," + _BM25
_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
_KEY = "lower(regexp_replace({0}, '[^0-9A-Za-z가-힣]+', '', 'g'))"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')))"

SQL = {
    "bm25_topk": _Q + "SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score, doc_id) AS INT) AS rank FROM z QUALIFY row_number() OVER (ORDER BY score, doc_id) <= 20",
    "bm25_filtered": _Q + """SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score, doc_id) AS INT) AS rank FROM z JOIN i USING (doc_id)
        WHERE mapped_subject = '영상검사학' AND conf IN ('high', 'medium') QUALIFY row_number() OVER (ORDER BY score, doc_id) <= 20""",
    "bm25_area_eval": "WITH q AS (SELECT DISTINCT area AS query, unnest(regexp_extract_all(lower(area), '[0-9a-z가-힣]+')) AS term FROM exam_scope)," + _BM25 + """,
        t AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score, doc_id) AS rank FROM z)
        SELECT query, CASE WHEN bool_or(coalesce(mapped_area = query, false) AND rank = 1) THEN 'pass' WHEN bool_or(coalesce(mapped_area = query, false)) THEN 'warn' ELSE 'fail' END AS verdict
        FROM t JOIN i USING (doc_id) WHERE rank <= 5 GROUP BY query""",
    "vector_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "vector_progressive": f"""WITH c AS (SELECT DISTINCT ON (doc_id) doc_id, mapped_subject AS s, mapped_field AS f, mapped_area AS a, mapped_detail AS d, concat_ws(' ', content, excerpt, metadata_json) AS text FROM chunks),
        r AS (SELECT vec_id, embedding, c.* FROM embeddings LEFT JOIN c ON doc_id = vec_id),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS cos, coalesce(b.text, '') AS text, list_distinct(list_filter(string_split_regex(replace(coalesce(a.d, ''), ',', ' '), '\\s+'), lambda t: length(t) >= 2)) AS terms,
            coalesce(trim(a.s, ' ') = '' OR trim(a.s, ' ') = trim(b.s, ' '), a.s IS NULL) AS s, coalesce(trim(a.f, ' ') = '' OR trim(a.f, ' ') = trim(b.f, ' '), a.f IS NULL) AS f,
            coalesce(trim(a.a, ' ') = '' OR trim(a.a, ' ') = trim(b.a, ' '), a.a IS NULL) AS a, coalesce(trim(a.d, ' ') = '' OR trim(a.d, ' ') = trim(b.d, ' '), a.d IS NULL) AS d FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        z AS (SELECT query_id, id, CASE WHEN s AND f AND a AND d THEN 0 WHEN s AND f AND a THEN 1 WHEN s AND f THEN 2 WHEN s THEN 3 ELSE 4 END AS level, round(cos + least(0.12, 0.05 * len(list_filter(terms, lambda t: contains(text, t))))::DOUBLE, 6) AS score FROM p)
        SELECT query_id, id, level, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY level, score DESC, id) AS INT) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level, score DESC, id) <= 6""",
    "multi_query_merge": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)
        SELECT id, query_id, score FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id) = 1) ORDER BY score DESC, id LIMIT 40""",
    "scored_scope_mapping": f"""WITH c AS (SELECT DISTINCT ON (rag_input_id) rag_input_id, mapped_subject, {_KEY.format('content')} AS k, {_WORDS.format('content')} AS w FROM chunks WHERE content IS NOT NULL),
        s AS (SELECT id, subject, {_KEY.format('nfc_normalize(detail)')} AS dk, {_KEY.format('area')} AS ak, {_WORDS.format("nfc_normalize(detail) || ' ' || area")} AS w FROM exam_scope),
        h AS (SELECT rag_input_id, id, contains(k, dk) AS d, contains(k, ak) AS a, len(list_intersect(c.w, s.w)) AS n FROM c JOIN s ON mapped_subject = subject),
        p AS (SELECT rag_input_id, id, CAST(CASE WHEN d THEN 8 ELSE 0 END + CASE WHEN a THEN 3 ELSE 0 END + 1.25 * (CAST(d AS INT) + CAST(a AS INT)) + least(6, 0.75 * n) AS DOUBLE) AS score FROM h)
        SELECT rag_input_id, id AS scope_id, score, CASE WHEN score >= 10 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'area_only' END AS confidence FROM p WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY rag_input_id ORDER BY score DESC, id) = 1""",
    "range_join_detail": """WITH c AS (SELECT DISTINCT id, area, page_start FROM source_chunk)
        SELECT c.id, (SELECT s.id FROM exam_scope s WHERE s.area = c.area AND s.source_page <= c.page_start ORDER BY s.source_page DESC, s.id LIMIT 1) AS scope_id FROM c""",
    "override_precedence": """WITH r AS (SELECT filename, 0 AS kind, id, unnest(CAST(json_extract(low_text_pages, '$[*]') AS INT[])) AS page, 'low page' AS t FROM source_document WHERE filename <> '' AND json_valid(low_text_pages)
            UNION ALL SELECT filename, 1, id, NULL, area FROM source_document WHERE filename <> '' AND area IS NOT NULL),
        c AS (SELECT DISTINCT rag_input_id, source_file, page_or_slide, mapped_area FROM chunks)
        SELECT c.rag_input_id, coalesce(t, mapped_area, 'none') AS area, t IS NOT NULL AS overridden FROM c LEFT JOIN r ON filename = source_file AND (page IS NULL OR page = page_or_slide)
        QUALIFY row_number() OVER (PARTITION BY c.rag_input_id ORDER BY kind, id) = 1""",
    "term_overlap": f"""WITH c AS (SELECT DISTINCT id, {_WORDS.format('stem')} AS s, {_WORDS.format('detail')} AS t FROM question_bank_candidate WHERE stem IS NOT NULL AND detail IS NOT NULL)
        SELECT DISTINCT id, CAST(len(list_intersect(s, t)) AS INT) AS shared, CAST(len(list_filter(t, lambda x: NOT list_contains(s, x))) AS INT) AS lacking FROM c""",
}
