"""Admission, exclusion and normalisation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.operators import gates
from granary.operators.retrieval import small
from granary.operators.sequences import best_list
from granary.plans.tables import _once
from granary.sources.tables import read_table


def _blank(name: str):
    return F.coalesce(F.trim(name), F.lit("")) == ""


def evidence_admission(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows against their chunks and source chunks: every one of twelve reasons that speak against one."""
    columns = {"there": F.lit(1), "h": F.col("content_sha256"), "p": F.col("page_or_slide"), "size": F.length("content"), "approved": F.col("approved_for_rag_evidence"), "state": F.col("candidate_rag_status"), "review": F.col("scope_mapping_needs_review"), "quality": F.col("extraction_quality"), "scope": F.col("mapped_scope_id")}
    chunks = _once(spark, d, "chunks", "rag_input_id").select("rag_input_id", *[c.alias(n) for n, c in columns.items()])
    known = read_table(spark, d, "source_chunk").select(F.col("id").alias("source_chunk_id"), F.lit(1).alias("source")).distinct()
    rows = _once(spark, d, "question_bank_candidate_evidence").join(chunks, "rag_input_id", "left").join(known, "source_chunk_id", "left")
    met = F.col("there").isNotNull()
    checks = [
        ("no_reference", F.col("rag_input_id").isNull()), ("missing_chunk", F.col("rag_input_id").isNotNull() & ~met), ("blank_hash", _blank("content_sha256")), ("hash_mismatch", ~_blank("content_sha256") & (F.col("content_sha256") != F.col("h"))),
        ("page_mismatch", F.col("page_or_slide") != F.col("p")), ("short", F.col("size") < 80), ("not_approved", met & ~F.col("approved").eqNullSafe(F.lit(1))), ("held", F.col("state") == "hold"), ("needs_review", F.col("review") == 1),
        ("low_quality", F.col("quality") == "low"), ("scope_mismatch", ~_blank("mapped_scope_id") & ~_blank("scope") & (F.col("mapped_scope_id") != F.col("scope"))), ("dangling_source", F.col("source_chunk_id").isNotNull() & F.col("source").isNull()),
    ]
    return rows.groupBy(F.array_join(gates.all_reasons(checks), ",").alias("reasons")).agg(F.count("*").alias("n"))


def vector_admission(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that keeps a chunk out of a vector index."""
    checks = [
        ("empty", _blank("content")), ("not_approved", ~F.col("approved_for_rag_evidence").eqNullSafe(F.lit(1))), ("excluded_status", F.coalesce("candidate_rag_status", F.lit("")).isin("", "hold")),
        ("needs_review", F.col("scope_mapping_needs_review") == 1),
    ]
    return _once(spark, d, "chunks", "rag_input_id").groupBy(gates.first_reason(checks, "included").alias("reason")).agg(F.count("*").alias("n"))


def low_page_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on the low pages of their file, with the documents that say so."""
    pages = read_table(spark, d, "source_document").filter("filename <> ''").select("id", F.col("filename").alias("source_file"), F.explode(F.from_json("low_text_pages", "array<int>")).alias("page_or_slide"))
    rows = _once(spark, d, "chunks", "rag_input_id").select("rag_input_id", "source_file", "page_or_slide").join(small(pages), ["source_file", "page_or_slide"])
    return rows.groupBy("rag_input_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("documents"))


MARKERS = ("그림", "표 ", "mGy", "CT", "hold")


def hold_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers found in any of several columns, whatever their case."""
    text = F.lower(F.concat_ws(" ", "content", "mapped_detail", "candidate_rag_status", "scope_mapping_status"))
    found = F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(text, F.lower(m)))
    return _once(spark, d, "chunks", "rag_input_id").select("rag_input_id", F.array_join(found, ",").alias("markers"))


def safe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each subject that all six flags allow."""
    flags = (
        F.col("approved_for_rag_evidence").eqNullSafe(F.lit(1)) & F.col("approved_for_generation").eqNullSafe(F.lit(0)) & F.col("scope_mapping_needs_review").eqNullSafe(F.lit(0))
        & F.coalesce(F.col("extraction_quality") != "low", F.lit(False)) & F.coalesce(F.col("scope_mapping_confidence") != "area_only", F.lit(False)) & F.col("candidate_rag_status").eqNullSafe(F.lit("ready_for_rag_evidence"))
    )
    return _once(spark, d, "chunks", "rag_input_id").groupBy("mapped_subject").agg(F.count_if(flags).alias("safe"), F.count("*").alias("n"))


def majority_flags(spark: SparkSession, d: str) -> DataFrame:
    """Scopes most of whose chunks are mapped by area alone."""
    rows = _once(spark, d, "chunks", "rag_input_id").filter("mapped_scope_id <> ''").groupBy("mapped_scope_id").agg(F.count("*").alias("n"), F.count_if(F.col("scope_mapping_confidence") == "area_only").alias("area_only"))
    return rows.select("mapped_scope_id", "n", (F.col("area_only") > F.floor(F.col("n") / 2)).alias("held"))


def folder_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the area whose code their folder has."""
    codes = read_table(spark, d, "subject_areas").select(F.lower("area_code").alias("folder"), "area_name")
    rows = read_table(spark, d, "source_document").select("id", F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]+)/[^/]+$", 1).alias("folder"))
    return rows.join(small(codes), "folder", "left").groupBy("folder", F.coalesce("area_name", F.lit("none")).alias("area_name")).agg(F.count("*").alias("n"))


HINTS = [("초음파", "us"), ("단층영상", "ct"), ("자기공명", "mr"), ("선량", "dose"), ("조영", "contrast")]


def alias_hints(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "subject", "field", "area", "detail", "stem")
    return _once(spark, d, "question_bank_candidate").select("id", V.first_hint(text, HINTS).alias("hint"), F.length(text).alias("size"))


def question_lists(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a list, a wrapper and a single object made of each candidate."""
    one = F.to_json(F.struct("id"))
    made = F.element_at(F.array(one, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")), F.concat(F.lit('{"questions":['), one, F.lit("]}")), F.lit("broken")), F.pmod(F.coalesce("answer", F.lit(0)), F.lit(4)) + 1)
    return _once(spark, d, "question_bank_candidate").select("id", F.size(V.entries_of(made)).alias("n"), F.coalesce(F.get_json_object(F.try_element_at(V.entries_of(made), F.lit(1)), "$.id"), F.lit("")).alias("first"))


def default_fields(spark: SparkSession, d: str) -> DataFrame:
    held = V.merged_defaults(F.col("metadata_json"), {"extraction_method": "unknown", "rag_input_id": "none", "language": "ko"})
    return _once(spark, d, "chunks", "rag_input_id").select("rag_input_id", F.to_json(held).alias("fields"))


def capped_references(spark: SparkSession, d: str) -> DataFrame:
    """The first two references of each candidate by role and id, as objects."""
    rows = _once(spark, d, "question_bank_candidate_evidence").select("candidate_id", "id", "rag_input_id", F.coalesce("evidence_role", F.lit("none")).alias("role"))
    return best_list(rows, ["candidate_id"], [F.asc("role"), F.asc("id")], 2, ["id", "role"]).select("candidate_id", F.to_json("best").alias("refs"))


def normal_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scope names of the candidates in one form: blanks as null, white space collapsed, the id or a hash."""
    from granary.functions.text import collapsed

    names = [V.none_if_blank(collapsed(F.col(c))).alias(c) for c in ("subject", "field", "area", "detail")]
    rows = _once(spark, d, "question_bank_candidate").select(F.col("id").alias("candidate"), F.coalesce(V.none_if_blank(F.col("scope_id")), F.lit("none")).alias("id"), *names)
    return rows.select("candidate", F.to_json(F.struct("id", "subject", "field", "area", "detail")).alias("scope"))


def difficulty_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate")
    return rows.groupBy("learning_objective_id", F.coalesce("difficulty", F.lit("none")).alias("difficulty")).agg(F.count("*").alias("n"))


def progress_counts(spark: SparkSession, d: str) -> DataFrame:
    """Validated, open (not below zero) and passed candidates of each subject, and the share done."""
    done = _once(spark, d, "question_bank_candidate_validation").groupBy(F.col("candidate_id").alias("id")).agg(F.max("passed").alias("passed"), F.count_if(F.col("verdict").isNotNull()).alias("judged"))
    rows = _once(spark, d, "question_bank_candidate").join(done, "id", "left")
    counts = rows.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("judged") > 0).alias("answered"), F.count_if(F.col("passed") == 1).alias("score"))
    return counts.select("subject", "answered", F.greatest(F.lit(0), F.col("n") - F.col("answered")).alias("unanswered"), "score", F.round(F.col("answered") / F.col("n"), 4).alias("progress"))


def quality_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every source document by quality band."""
    rows = _once(spark, d, "source_chunk").withColumn("band", gates.quality_band(F.length(F.coalesce("content", F.lit("")))))
    return rows.groupBy("document_id").pivot("band", ["high", "medium", "low"]).count().na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_admission, vector_admission, low_page_exclusion, hold_markers, safe_rows, majority_flags, folder_scopes, alias_hints, question_lists, default_fields, capped_references, normal_scopes,
        difficulty_histogram, progress_counts, quality_by_document,
    )
}

_C = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate)"
_E = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_evidence)"
_V = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_validation)"
_K = "(SELECT DISTINCT ON (rag_input_id) * FROM chunks)"
_S = "(SELECT DISTINCT ON (id) * FROM source_chunk)"
_FLAT = r"nullif(trim(regexp_replace({0}, '\s+', ' ', 'g'), ' '), '')"


def _json_field(name: str, value: str, first: bool = False) -> str:
    return f"""CASE WHEN {value} IS NULL THEN '' ELSE '{'' if first else ','}"{name}":' || CAST(to_json({value}) AS VARCHAR) END"""


SQL = {
    "evidence_admission": f"""WITH j AS (SELECT e.*, c.rag_input_id AS there, c.content_sha256 AS h, c.page_or_slide AS p, length(c.content) AS size, c.approved_for_rag_evidence AS approved, c.candidate_rag_status AS state, c.scope_mapping_needs_review AS review,
            c.extraction_quality AS quality, c.mapped_scope_id AS scope, s.id AS source FROM {_E} e LEFT JOIN {_K} c ON c.rag_input_id = e.rag_input_id LEFT JOIN {_S} s ON s.id = e.source_chunk_id),
        r AS (SELECT list_sort(list_filter([CASE WHEN rag_input_id IS NULL THEN 'no_reference' END, CASE WHEN rag_input_id IS NOT NULL AND there IS NULL THEN 'missing_chunk' END, CASE WHEN coalesce(content_sha256, '') = '' THEN 'blank_hash' END,
            CASE WHEN content_sha256 <> '' AND content_sha256 <> h THEN 'hash_mismatch' END, CASE WHEN page_or_slide <> p THEN 'page_mismatch' END, CASE WHEN size < 80 THEN 'short' END, CASE WHEN there IS NOT NULL AND approved IS DISTINCT FROM 1 THEN 'not_approved' END,
            CASE WHEN state = 'hold' THEN 'held' END, CASE WHEN review = 1 THEN 'needs_review' END, CASE WHEN quality = 'low' THEN 'low_quality' END, CASE WHEN mapped_scope_id <> '' AND scope <> '' AND mapped_scope_id <> scope THEN 'scope_mismatch' END,
            CASE WHEN source_chunk_id IS NOT NULL AND source IS NULL THEN 'dangling_source' END], lambda x: x IS NOT NULL)) AS l FROM j)
        SELECT array_to_string(l, ',') AS reasons, count(*) AS n FROM r GROUP BY 1""",
    "vector_admission": f"""SELECT CASE WHEN coalesce(trim(content, ' '), '') = '' THEN 'empty' WHEN approved_for_rag_evidence IS DISTINCT FROM 1 THEN 'not_approved' WHEN coalesce(candidate_rag_status, '') IN ('', 'hold') THEN 'excluded_status'
        WHEN scope_mapping_needs_review = 1 THEN 'needs_review' ELSE 'included' END AS reason, count(*) AS n FROM {_K} GROUP BY 1""",
    "low_page_exclusion": f"""WITH p AS (SELECT id, filename, unnest(CAST(json_extract(low_text_pages, '$[*]') AS INT[])) AS page FROM source_document WHERE filename <> '' AND json_valid(low_text_pages))
        SELECT rag_input_id, string_agg(DISTINCT id, ',' ORDER BY id) AS documents FROM {_K} JOIN p ON filename = source_file AND page = page_or_slide GROUP BY 1""",
    "hold_markers": f"""SELECT rag_input_id, array_to_string(list_filter(['그림', '표 ', 'mGy', 'CT', 'hold'], lambda m: contains(lower(concat_ws(' ', content, mapped_detail, candidate_rag_status, scope_mapping_status)), lower(m))), ',') AS markers FROM {_K}""",
    "safe_rows": f"""SELECT mapped_subject, count(*) FILTER (approved_for_rag_evidence = 1 AND approved_for_generation = 0 AND scope_mapping_needs_review = 0 AND extraction_quality <> 'low' AND scope_mapping_confidence <> 'area_only' AND candidate_rag_status = 'ready_for_rag_evidence') AS safe, count(*) AS n FROM {_K} GROUP BY 1""",
    "majority_flags": f"SELECT mapped_scope_id, count(*) AS n, count(*) FILTER (scope_mapping_confidence = 'area_only') > count(*) // 2 AS held FROM {_K} WHERE mapped_scope_id <> '' GROUP BY 1",
    "folder_scopes": "SELECT regexp_extract(coalesce(path, ''), '([^/]+)/[^/]+$', 1) AS folder, coalesce(area_name, 'none') AS area_name, count(*) AS n FROM source_document LEFT JOIN subject_areas ON lower(area_code) = regexp_extract(coalesce(path, ''), '([^/]+)/[^/]+$', 1) GROUP BY ALL",
    "alias_hints": f"""WITH t AS (SELECT id, concat_ws(' ', subject, field, area, detail, stem) AS x FROM {_C})
        SELECT id, CASE WHEN contains(x, '초음파') THEN 'us' WHEN contains(x, '단층영상') THEN 'ct' WHEN contains(x, '자기공명') THEN 'mr' WHEN contains(x, '선량') THEN 'dose' WHEN contains(x, '조영') THEN 'contrast' END AS hint, CAST(length(x) AS INT) AS size FROM t""",
    "question_lists": f"SELECT id, (([1, 2, 1, 0])[((coalesce(answer, 0) % 4) + 4) % 4 + 1])::INT AS n, CASE WHEN ((coalesce(answer, 0) % 4) + 4) % 4 = 3 THEN '' ELSE id END AS first FROM {_C}",
    "default_fields": f"""SELECT rag_input_id, '{{' || {_json_field('extraction_method', "coalesce(nullif(trim(json_extract_string(metadata_json, '$.extraction_method'), ' '), ''), 'unknown')", True)}
        || {_json_field('rag_input_id', "coalesce(nullif(json_extract_string(metadata_json, '$.rag_input_id'), ''), 'none')")} || ',"language":"ko"}}' AS fields FROM {_K}""",
    "capped_references": f"""WITH r AS (SELECT candidate_id, id, coalesce(evidence_role, 'none') AS role, row_number() OVER (PARTITION BY candidate_id ORDER BY coalesce(evidence_role, 'none'), id) AS n FROM {_E})
        SELECT candidate_id, '[' || string_agg('{{"id":"' || id || '","role":"' || role || '"}}', ',' ORDER BY n) || ']' AS refs FROM r WHERE n <= 2 GROUP BY 1""",
    "normal_scopes": f"""SELECT id AS candidate, '{{"id":"' || coalesce(nullif(trim(scope_id, ' '), ''), 'none') || '"' || {_json_field('subject', _FLAT.format('subject'))} || {_json_field('field', _FLAT.format('field'))} || {_json_field('area', _FLAT.format('area'))} || {_json_field('detail', _FLAT.format('detail'))} || '}}' AS scope FROM {_C}""",
    "difficulty_histogram": f"SELECT learning_objective_id, coalesce(difficulty, 'none') AS difficulty, count(*) AS n FROM {_C} GROUP BY ALL",
    "progress_counts": f"""WITH v AS (SELECT candidate_id, max(passed) AS p, count(verdict) AS j FROM {_V} GROUP BY 1)
        SELECT subject, count(*) FILTER (j > 0) AS answered, count(*) - count(*) FILTER (j > 0) AS unanswered, count(*) FILTER (p = 1) AS score, round(count(*) FILTER (j > 0) / count(*), 4) AS progress FROM {_C} c LEFT JOIN v ON v.candidate_id = c.id GROUP BY 1""",
    "quality_by_document": f"SELECT document_id, count(*) FILTER (length(coalesce(content, '')) >= 500) AS high, count(*) FILTER (length(coalesce(content, '')) BETWEEN 120 AND 499) AS medium, count(*) FILTER (length(coalesce(content, '')) < 120) AS low FROM {_S} GROUP BY 1",
}
