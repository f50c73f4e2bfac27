"""Aggregate, join, window and store queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.operators import sequences as S
from granary.operators import store
from granary.operators.retrieval import small, top
from granary.sources.tables import read_table
from granary.streaming.incremental import still_to_do


def _once(spark: SparkSession, d: str, name: str, key: str = "id") -> DataFrame:
    """Redelivered rows repeat an earlier one with the same values: one of each."""
    return read_table(spark, d, name).dropDuplicates([key])


def candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").withColumn("qt", F.coalesce("question_type", F.lit("none")))
    cube = rows.groupingSets([["status"], ["subject"], ["source_stage"], ["qt"]], "status", "subject", "source_stage", "qt")
    out = cube.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "status").when(F.col("g") == 11, "subject").when(F.col("g") == 13, "source_stage").otherwise("question_type")
    return out.select(kind.alias("kind"), F.coalesce("status", "subject", "source_stage", "qt", F.lit("none")).alias("value"), "n")


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate_validation")
    return rows.groupBy("validation_stage", F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"), F.sum("passed").alias("passed"))


def scope_group_having(spark: SparkSession, d: str) -> DataFrame:
    keys = ["mapped_period", "mapped_subject", "mapped_field", "mapped_area", "mapped_detail"]
    rows = _once(spark, d, "chunks", "rag_input_id").filter("mapped_detail is not null")
    agg = rows.groupBy(*keys).agg(F.count("*").alias("evidence"), F.count_if(F.col("scope_mapping_confidence") == "high").alias("high"), F.count_if(F.col("scope_mapping_needs_review") == 1).alias("review"), F.count_distinct("source_file").alias("files"))
    return agg.filter("evidence >= 2")


def evidence_topk_per_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "chunks", "rag_input_id").filter("mapped_scope_id is not null and mapped_scope_id <> ''")
    band = F.when(F.col("scope_mapping_confidence") == "high", 0).when(F.col("scope_mapping_confidence") == "medium", 1).otherwise(2)
    order = [band, F.coalesce("scope_mapping_needs_review", F.lit(0)), F.coalesce("page_or_slide", F.lit(0)), F.col("rag_input_id")]
    return top(rows, ["mapped_scope_id"], order, 5).select("mapped_scope_id", "rag_input_id", "rank")


def semi_join_safe(spark: SparkSession, d: str) -> DataFrame:
    safe = read_table(spark, d, "chunks").filter("approved_for_rag_evidence = 1").select("rag_input_id")
    rows = _once(spark, d, "question_bank_candidate_evidence").join(safe, "rag_input_id", "left_semi")
    return rows.groupBy("evidence_role").agg(F.count("*").alias("n"))


def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    known = read_table(spark, d, "source_chunk").select(F.col("id").alias("source_chunk_id")).distinct()
    rows = _once(spark, d, "question_bank_candidate_evidence").filter("source_chunk_id is not null").join(known, "source_chunk_id", "left_anti")
    return rows.select("id", "source_chunk_id")


def coverage_audit_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Every area of the scope list and of the candidates, those without the other kept with zeros."""
    scope = read_table(spark, d, "exam_scope").groupBy("area").agg(F.count("*").alias("details"), F.sum(F.coalesce("question_count", F.lit(0))).alias("wanted"))
    made = _once(spark, d, "question_bank_candidate").groupBy("area").agg(F.count("*").alias("made"), F.count_if(F.col("status") == "expert_passed").alias("passed"))
    return scope.join(made, "area", "full_outer").select("area", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("details", "wanted", "made", "passed")])


def top3_sources_string(spark: SparkSession, d: str) -> DataFrame:
    counts = _once(spark, d, "chunks", "rag_input_id").filter("mapped_subject is not null").groupBy("mapped_subject", "source_file").agg(F.count("*").alias("n"))
    best = top(counts, ["mapped_subject"], [F.desc("n"), F.asc("source_file")], 3)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "source_file", F.col("n").cast("string")).alias("s"))))
    return best.groupBy("mapped_subject").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("sources"))


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate")
    out = rows.groupBy("subject").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("expert_passed", "pending_expert_review")], F.count("*").alias("total"))
    return out


def blueprint_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "exam_scope")
    out = rows.rollup("period", "subject", "field", "area").agg(F.count("*").alias("details"), F.sum("question_count").alias("questions"), F.grouping_id().alias("level"))
    return out.withColumn("level", F.col("level").cast("int"))


def answer_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").filter("answer between 1 and 5")
    return rows.cube("subject", "answer").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def candidate_list_paged(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").filter((F.col("status") == "pending_expert_review") & F.coalesce("stem", F.lit("")).ilike("%선량%"))
    return store.page_of(rows, [F.desc("updated"), F.desc("created"), F.asc("id")], 2, 25).select("id", "subject", "updated")


def correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").select("id", "status")
    children = {"evidence_count": (_once(spark, d, "question_bank_candidate_evidence"), "candidate_id"), "validation_count": (_once(spark, d, "question_bank_candidate_validation"), "candidate_id")}
    return store.with_child_counts(rows, "id", children)


def candidate_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Options from the JSON list where it is filled, else from the columns."""
    rows = _once(spark, d, "question_bank_candidate")
    columns = F.array(*[F.coalesce(f"option_{i}", F.lit("")) for i in range(1, 6)])
    listed = V.string_list(F.col("options_json"))
    return rows.select("id", F.array_join(F.when(F.size(listed) == 5, listed).otherwise(columns), "|").alias("options"), F.coalesce(V.none_if_blank(F.col("question_type")), F.lit("none")).alias("question_type"))


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate_validation")
    return store.latest(rows, "candidate_id", [F.desc_nulls_last("created"), F.desc("id")]).select("candidate_id", "validation_stage", "passed")


def selectable_status(spark: SparkSession, d: str) -> DataFrame:
    """Per subject the passed candidates, or the pending ones where none has passed."""
    rows = _once(spark, d, "question_bank_candidate")
    passed = rows.groupBy("subject").agg(F.max(F.col("status") == "expert_passed").alias("any_passed"))
    chosen = rows.join(passed, "subject").filter(F.col("status") == F.when(F.col("any_passed"), "expert_passed").otherwise("pending_expert_review"))
    return chosen.groupBy("subject").agg(F.count("*").alias("n"))


def _stage(column: str = "source_stage"):
    return F.when(F.col(column) == "revised_pass", 0).when(F.col(column) == "quota_pass", 1).when(F.col(column) == "initial_pass", 2).otherwise(8)


def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    pool = _once(spark, d, "question_bank_candidate").filter("status = 'expert_passed' and scope_id is not null")
    quotas = read_table(spark, d, "exam_scope").filter("question_count is not null").select(F.col("id").alias("scope_id"), F.col("question_count").alias("need"))
    return S.fill_quota(pool, quotas, ["scope_id"], "need", [_stage(), F.sha2("id", 256)]).select("scope_id", "id")


def quota_gaps(spark: SparkSession, d: str) -> DataFrame:
    scope = read_table(spark, d, "exam_scope").filter("question_count is not null").select(F.col("id").alias("scope_id"), "question_count")
    filled = quota_fill(spark, d).groupBy("scope_id").agg(F.count("*").alias("filled"))
    return scope.join(filled, "scope_id", "left").select("scope_id", (F.col("question_count") - F.coalesce("filled", F.lit(0))).cast("int").alias("gap")).filter("gap > 0")


def round_robin_target(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").filter("answer between 1 and 5 and subject is not null")
    return S.round_robin(rows.select("id", "subject"), ["subject"], [F.asc("id")], 5).select("id", "target")


def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "chunks", "rag_input_id").filter("mapped_scope_id is not null and mapped_scope_id <> ''").select("mapped_scope_id", "source_file", "page_or_slide", "rag_input_id")
    order = [F.asc("source_file"), F.coalesce("page_or_slide", F.lit(0)), F.asc("rag_input_id")]
    return S.consecutive_pairs(rows, ["mapped_scope_id"], order, ["rag_input_id"]).select("mapped_scope_id", F.col("pair").cast("int").alias("pair"), "rag_input_id_1", "rag_input_id_2")


def variant_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "exam_scope").select("id", F.coalesce("question_count", F.lit(0)).alias("n"))
    kinds = F.array(F.lit("concept"), F.lit("apply"), F.lit("compare"))
    return S.fanned_out(rows, F.col("n")).select("id", "variant", F.element_at(kinds, F.col("variant") % 3 + 1).alias("kind"))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """The last mapped detail before each chunk of a file, in reading order."""
    rows = _once(spark, d, "chunks", "rag_input_id").withColumn("detail", V.none_if_blank(F.col("mapped_detail")))
    filled = S.filled_forward(rows.select("rag_input_id", "source_file", "doc_id", "detail"), "detail", ["source_file"], ["doc_id"])
    return filled.select("rag_input_id", F.coalesce("filled", F.lit("")).alias("filled"))


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "source_chunk").select("id", "document_id", "chunk_index")
    return S.neighbours(rows, ["document_id"], [F.asc("chunk_index"), F.asc("id")], "id").select("id", "before", "after")


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate_evidence").filter("rag_input_id is not null")
    return S.first_per_key(rows, ["candidate_id", "rag_input_id"], [F.asc("created"), F.asc("id")]).select("candidate_id", "rag_input_id", "id")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate_evidence").filter("rag_input_id is not null")
    return S.first_per_key(rows, ["candidate_id", "rag_input_id"], [F.desc("created"), F.desc("id")]).select("candidate_id", "rag_input_id", "id")


def conflicting_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that evidence rows map to more than one scope."""
    rows = _once(spark, d, "question_bank_candidate_evidence").filter("rag_input_id is not null and mapped_scope_id <> ''")
    return rows.groupBy("rag_input_id").agg(F.count_distinct("mapped_scope_id").alias("scopes")).filter("scopes > 1")


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "source_chunk").filter("page_start > 0")
    return rows.groupBy("document_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.count("*").alias("chunks"), F.count_if(F.length(F.coalesce("content", F.lit(""))) < 120).alias("low"))


def upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    """The revised candidates written over the store: their status and first date stay."""
    rows = _once(spark, d, "question_bank_candidate").select("id", "status", "created", "updated", "source_stage")
    new = rows.filter("source_stage = 'revised_pass'").select("id", F.lit("imported").alias("status"), F.col("updated").alias("created"), "updated", F.lit("again").alias("source_stage"))
    return store.upserted(rows, new, "id", ["status", "created"])


def incremental_resume(spark: SparkSession, d: str) -> DataFrame:
    """Pages of source chunks that no chunk of the index has yet."""
    work = read_table(spark, d, "source_chunk").select("id", "page_start").distinct()
    done = read_table(spark, d, "chunks").select(F.col("source_chunk_id").alias("id"))
    return still_to_do(work, done, ["id"]).select("id", "page_start")


def diversity(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate_evidence")
    return rows.groupBy("candidate_id").agg(F.count_distinct("source_file").alias("files"), F.count_distinct("source_file", "page_or_slide").alias("pages"), F.count("*").alias("refs"))


def scope_join_compact(spark: SparkSession, d: str) -> DataFrame:
    """Candidates joined to the scope list by compacted subject, field and area."""
    scope = read_table(spark, d, "exam_scope").select(V.scope_key(F.col("subject"), F.col("field"), F.col("area")).alias("k")).distinct()
    rows = _once(spark, d, "question_bank_candidate").withColumn("k", V.scope_key(F.col("subject"), F.col("field"), F.col("area")))
    return rows.join(small(scope.withColumn("known", F.lit(True))), "k", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    return events.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        candidate_summary, verdict_counts, scope_group_having, evidence_topk_per_scope, semi_join_safe, anti_join_missing, coverage_audit_full_outer,
        top3_sources_string, status_pivot, blueprint_rollup, answer_cube, candidate_list_paged, correlated_counts, candidate_hydrate, latest_status, selectable_status, quota_fill, quota_gaps,
        round_robin_target, consecutive_pairs, variant_fanout, forward_fill, context_lines, dedupe_first, dedupe_last, conflicting_scopes, page_ranges, upsert_preserve,
        incremental_resume, diversity, scope_join_compact, hourly_events,
    )
}

_C = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate)"
_E = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_evidence)"
_V = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_validation)"
_K = "(SELECT DISTINCT ON (rag_input_id) * FROM chunks)"
_S = "(SELECT DISTINCT ON (id) * FROM source_chunk)"
_RANK = "CASE source_stage WHEN 'revised_pass' THEN 0 WHEN 'quota_pass' THEN 1 WHEN 'initial_pass' THEN 2 ELSE 8 END, sha256(id)"
_FILL = f"""(SELECT c.scope_id, c.id FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY {_RANK}) AS n FROM {_C} WHERE status = 'expert_passed' AND scope_id IS NOT NULL) c
    JOIN exam_scope s ON s.id = c.scope_id WHERE c.n <= s.question_count)"""
_KEY = "lower(regexp_replace(coalesce({0}, ''), '[^0-9A-Za-z가-힣]+', '', 'g'))"
_SK = "{0} || '|' || {1} || '|' || {2}".format(*[_KEY.format(c) for c in ("subject", "field", "area")])

SQL = {
    "candidate_summary": f"""SELECT 'status' AS kind, coalesce(status, 'none') AS value, count(*) AS n FROM {_C} GROUP BY ALL UNION ALL SELECT 'subject', coalesce(subject, 'none'), count(*) FROM {_C} GROUP BY ALL
        UNION ALL SELECT 'source_stage', coalesce(source_stage, 'none'), count(*) FROM {_C} GROUP BY ALL UNION ALL SELECT 'question_type', coalesce(question_type, 'none'), count(*) FROM {_C} GROUP BY ALL""",
    "verdict_counts": f"SELECT validation_stage, coalesce(verdict, 'none') AS verdict, count(*) AS n, CAST(sum(passed) AS BIGINT) AS passed FROM {_V} GROUP BY ALL",
    "scope_group_having": f"""SELECT mapped_period, mapped_subject, mapped_field, mapped_area, mapped_detail, count(*) AS evidence, count(*) FILTER (scope_mapping_confidence = 'high') AS high, count(*) FILTER (scope_mapping_needs_review = 1) AS review,
        count(DISTINCT source_file) AS files FROM {_K} WHERE mapped_detail IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "evidence_topk_per_scope": f"""SELECT mapped_scope_id, rag_input_id, CAST(row_number() OVER w AS INT) AS rank FROM {_K} WHERE mapped_scope_id <> ''
        WINDOW w AS (PARTITION BY mapped_scope_id ORDER BY CASE scope_mapping_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, coalesce(scope_mapping_needs_review, 0), coalesce(page_or_slide, 0), rag_input_id) QUALIFY row_number() OVER w <= 5""",
    "semi_join_safe": f"SELECT evidence_role, count(*) AS n FROM {_E} WHERE rag_input_id IN (SELECT rag_input_id FROM chunks WHERE approved_for_rag_evidence = 1) GROUP BY ALL",
    "anti_join_missing": f"SELECT id, source_chunk_id FROM {_E} e WHERE source_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_chunk s WHERE s.id = e.source_chunk_id)",
    "coverage_audit_full_outer": f"""SELECT area, coalesce(details, 0) AS details, CAST(coalesce(wanted, 0) AS BIGINT) AS wanted, coalesce(made, 0) AS made, coalesce(passed, 0) AS passed
        FROM (SELECT area, count(*) AS details, sum(coalesce(question_count, 0)) AS wanted FROM exam_scope GROUP BY area) s FULL JOIN (SELECT area, count(*) AS made, count(*) FILTER (status = 'expert_passed') AS passed FROM {_C} GROUP BY area) c USING (area)""",
    "top3_sources_string": f"""WITH c AS (SELECT mapped_subject, source_file, count(*) AS n FROM {_K} WHERE mapped_subject IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY mapped_subject ORDER BY n DESC, source_file) AS r FROM c)
        SELECT mapped_subject, string_agg(concat_ws(':', source_file, n), ', ' ORDER BY r) AS sources FROM t WHERE r <= 3 GROUP BY 1""",
    "status_pivot": f"SELECT subject, count(*) FILTER (status = 'expert_passed') AS expert_passed, count(*) FILTER (status = 'pending_expert_review') AS pending_expert_review, count(*) AS total FROM {_C} GROUP BY subject",
    "blueprint_rollup": "SELECT period, subject, field, area, count(*) AS details, CAST(sum(question_count) AS BIGINT) AS questions, CAST(grouping_id(period, subject, field, area) AS INT) AS level FROM exam_scope GROUP BY ROLLUP (period, subject, field, area)",
    "answer_cube": f"SELECT subject, answer, count(*) AS n, CAST(grouping_id(subject, answer) AS INT) AS level FROM {_C} WHERE answer BETWEEN 1 AND 5 GROUP BY CUBE (subject, answer)",
    "candidate_list_paged": f"SELECT id, subject, updated FROM {_C} WHERE status = 'pending_expert_review' AND stem ILIKE '%선량%' ORDER BY updated DESC NULLS LAST, created DESC NULLS LAST, id LIMIT 25 OFFSET 25",
    "correlated_counts": f"SELECT id, status, (SELECT count(*) FROM {_E} e WHERE e.candidate_id = c.id) AS evidence_count, (SELECT count(*) FROM {_V} v WHERE v.candidate_id = c.id) AS validation_count FROM {_C} c",
    "candidate_hydrate": f"""WITH t AS (SELECT *, TRY_CAST(options_json AS VARCHAR[]) AS raw, CASE WHEN json_valid(options_json) THEN json_extract_string(options_json, '$[*]') END AS listed FROM {_C})
        SELECT id, CASE WHEN len(listed) = 5 THEN array_to_string(listed, '|') ELSE coalesce(option_1, '') || '|' || coalesce(option_2, '') || '|' || coalesce(option_3, '') || '|' || coalesce(option_4, '') || '|' || coalesce(option_5, '') END AS options,
        CASE WHEN trim(question_type, ' ') <> '' THEN question_type ELSE 'none' END AS question_type FROM t""",
    "latest_status": f"SELECT candidate_id, validation_stage, passed FROM {_V} QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY created DESC NULLS LAST, id DESC) = 1",
    "selectable_status": f"""WITH p AS (SELECT subject, bool_or(status = 'expert_passed') AS a FROM {_C} GROUP BY subject)
        SELECT c.subject, count(*) AS n FROM {_C} c JOIN p ON c.subject = p.subject WHERE status = CASE WHEN a THEN 'expert_passed' ELSE 'pending_expert_review' END GROUP BY c.subject""",
    "quota_fill": f"SELECT scope_id, id FROM {_FILL}",
    "quota_gaps": f"SELECT s.id AS scope_id, CAST(question_count - count(f.id) AS INT) AS gap FROM exam_scope s LEFT JOIN {_FILL} f ON f.scope_id = s.id WHERE question_count IS NOT NULL GROUP BY s.id, question_count HAVING question_count - count(f.id) > 0",
    "round_robin_target": f"SELECT id, CAST((row_number() OVER (PARTITION BY subject ORDER BY id) - 1) % 5 + 1 AS INT) AS target FROM {_C} WHERE answer BETWEEN 1 AND 5 AND subject IS NOT NULL",
    "consecutive_pairs": f"""WITH t AS (SELECT mapped_scope_id, rag_input_id, row_number() OVER (PARTITION BY mapped_scope_id ORDER BY source_file NULLS FIRST, coalesce(page_or_slide, 0), rag_input_id) - 1 AS n FROM {_K} WHERE mapped_scope_id <> '')
        SELECT mapped_scope_id, CAST(n // 2 AS INT) AS pair, max(rag_input_id) FILTER (n % 2 = 0) AS rag_input_id_1, max(rag_input_id) FILTER (n % 2 = 1) AS rag_input_id_2 FROM t GROUP BY 1, 2 HAVING count(*) = 2""",
    "variant_fanout": "SELECT id, CAST(i AS INT) AS variant, (['concept', 'apply', 'compare'])[i % 3 + 1] AS kind FROM (SELECT id, unnest(range(0, coalesce(question_count, 0))) AS i FROM exam_scope)",
    "forward_fill": f"""SELECT rag_input_id, coalesce(last_value(CASE WHEN trim(mapped_detail, ' ') <> '' THEN mapped_detail END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS filled FROM {_K}""",
    "context_lines": f"SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM {_S} WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, id)",
    "dedupe_first": f"SELECT candidate_id, rag_input_id, id FROM {_E} WHERE rag_input_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, rag_input_id ORDER BY created NULLS FIRST, id) = 1",
    "dedupe_last": f"SELECT candidate_id, rag_input_id, id FROM {_E} WHERE rag_input_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id, rag_input_id ORDER BY created DESC NULLS LAST, id DESC) = 1",
    "conflicting_scopes": f"SELECT rag_input_id, count(DISTINCT mapped_scope_id) AS scopes FROM {_E} WHERE rag_input_id IS NOT NULL AND mapped_scope_id <> '' GROUP BY 1 HAVING count(DISTINCT mapped_scope_id) > 1",
    "page_ranges": f"SELECT document_id, min(page_start) AS first_page, max(page_end) AS last_page, count(*) AS chunks, count(*) FILTER (length(coalesce(content, '')) < 120) AS low FROM {_S} WHERE page_start > 0 GROUP BY 1",
    "upsert_preserve": f"SELECT id, status, created, updated, CASE WHEN source_stage = 'revised_pass' THEN 'again' ELSE source_stage END AS source_stage FROM {_C}",
    "incremental_resume": "SELECT DISTINCT id, page_start FROM source_chunk s WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_chunk_id = s.id)",
    "diversity": f"SELECT candidate_id, count(DISTINCT source_file) AS files, count(DISTINCT CASE WHEN source_file IS NOT NULL AND page_or_slide IS NOT NULL THEN source_file || ':' || page_or_slide END) AS pages, count(*) AS refs FROM {_E} GROUP BY 1",
    "scope_join_compact": f"SELECT k.k IS NOT NULL AS known, count(*) AS n FROM (SELECT {_SK} AS k FROM {_C}) c LEFT JOIN (SELECT DISTINCT {_SK} AS k FROM exam_scope) k ON c.k = k.k GROUP BY 1",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
