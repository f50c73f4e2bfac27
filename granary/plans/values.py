"""Text, id, number, date and JSON queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import dates as D
from granary.functions import text as X
from granary.functions import values as V
from granary.operators.retrieval import small
from granary.plans.tables import _once
from granary.sources.tables import read_table

OPTIONS = [f"option_{i}" for i in range(1, 6)]


def _options():
    return F.array(*[F.coalesce(F.col(o), F.lit("")) for o in OPTIONS])


def excerpt_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts at the other sizes in use, and the one-character ellipsis form."""
    made = {f"e{n}": X.excerpt(F.col("content"), n) for n in (320, 700)} | {"within": X.excerpt_within(F.col("content"), 240)}
    return read_table(spark, d, "chunks").select("rag_input_id", *[F.sha2(c, 256).alias(n) for n, c in made.items()]).distinct()


def composed_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks").filter("mapped_detail is not null")
    return rows.groupBy(X.composed_key(F.col("mapped_detail")).alias("detail_key")).agg(F.count("*").alias("n"))


def page_cleaning(spark: SparkSession, d: str) -> DataFrame:
    page = X.clean_page(F.col("content"))
    return read_table(spark, d, "source_chunk").filter("content is not null").select("id", F.sha2(page, 256).alias("page"), F.sha2(X.clean_cell(F.col("content")), 256).alias("cell")).distinct()


def word_sets(spark: SparkSession, d: str) -> DataFrame:
    """Words of the stem without suffix and stop words."""
    found = X.word_set(F.col("stem"), ("옳은", "것은", "대한", "관한"))
    return read_table(spark, d, "question_bank_candidate").filter("stem is not null").select("id", F.array_join(F.array_sort(found), " ").alias("words")).distinct()


def boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each area as boost terms against the chunks mapped to it: 0.05 a term found, 0.12 at most."""
    rows = read_table(spark, d, "chunks").filter("mapped_area is not null and content is not null")
    score = V.boosted(F.lit(0.0), F.concat_ws(" ", "content", "excerpt", "metadata_json"), X.boost_terms(F.col("mapped_area")))
    return rows.select("rag_input_id", F.round(score, 4).alias("boost"), X.any_of(X.boost_terms(F.col("mapped_area"))).alias("query")).distinct()


def containment_match(spark: SparkSession, d: str) -> DataFrame:
    """Typed details that contain, or are contained in, a listed detail of the same area."""
    typed = read_table(spark, d, "chunks").select("mapped_area", "mapped_detail").dropna().distinct()
    listed = read_table(spark, d, "exam_scope").select(F.col("area").alias("mapped_area"), F.col("id").alias("scope_id"), "detail")
    return typed.join(small(listed), "mapped_area").filter(X.contains_either(F.col("mapped_detail"), F.col("detail"))).select("mapped_area", "mapped_detail", "scope_id")


def window_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Explanations against the windows of their evidence chunks."""
    rows = _once(spark, d, "question_bank_candidate").select(F.col("id").alias("candidate_id"), "explanation").dropna()
    evidence = read_table(spark, d, "question_bank_candidate_evidence").filter("evidence_role = 'supporting'").select("candidate_id", "rag_input_id").dropna().distinct()
    chunks = _once(spark, d, "chunks", "rag_input_id").select("rag_input_id", "content").dropna()
    pairs = rows.join(evidence, "candidate_id").join(chunks, "rag_input_id")
    return pairs.select("candidate_id", "rag_input_id", F.round(X.max_window_similarity("explanation", "content"), 6).alias("similarity"))


def paragraph_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.posexplode(X.paragraph_chunks()("text")).alias("piece", "content")).select("doc_id", "piece", F.length("content").alias("n_chars"))


def file_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "source_document")
    return rows.select("id", X.slug(F.concat_ws(" ", "title", "filename")).alias("slug"), X.html_escaped(F.concat(F.lit("<b>"), "title", F.lit("</b>"))).alias("shown"), F.format_string("%08d", "page_count").alias("padded"), F.format_number(F.col("page_count") * 1000, 0).alias("thousands"))


def option_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "question_bank_candidate")
    return rows.select("id", X.markdown_row(_options()).alias("line"), F.array_join(X.unique_labels(_options(), 10, 3), "|").alias("labels")).distinct()


def level_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers put before the first option, found and removed again."""
    marked = F.concat(F.lit("(가) ("), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("D")), F.coalesce("answer", F.lit(0)) % 3 + 1), F.lit(") "), F.coalesce("option_1", F.lit("")))
    rows = read_table(spark, d, "question_bank_candidate").filter("answer between 0 and 9").select("id", marked.alias("m"))
    return rows.select("id", X.level_marker(F.col("m")).alias("level"), X.without_level_marker(F.col("m")).alias("rest")).distinct()


KEYWORDS = ["선량", "초음파", "조영", "격자", "에너지", "차폐"]


def keyword_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold one of the keywords, with those found and the first 600 characters."""
    rows = read_table(spark, d, "source_chunk").filter("content is not null").withColumn("hits", X.keyword_hits(F.col("content"), KEYWORDS))
    return rows.filter(F.size("hits") > 0).select("id", F.array_join("hits", ",").alias("hits"), F.sha2(F.substring("content", 1, 600), 256).alias("head")).distinct()


def unit_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with units of an explanation that stand, without blanks, in none of its evidence chunks."""
    stems = read_table(spark, d, "question_bank_candidate").select(F.col("id").alias("candidate_id"), F.explode(X.numbers_with_units(F.col("explanation"))).alias("number")).distinct()
    evidence = read_table(spark, d, "question_bank_candidate_evidence").select("candidate_id", "rag_input_id").dropna().distinct()
    chunks = read_table(spark, d, "chunks").select("rag_input_id", F.explode(X.numbers_with_units(F.col("content"))).alias("number")).distinct()
    there = evidence.join(chunks, "rag_input_id").select("candidate_id", "number").distinct()
    return stems.join(there, ["candidate_id", "number"], "left_anti")


def made_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from canonical objects, SHA-1 slugs, candidate parts, and the id or else a hash."""
    rows = read_table(spark, d, "question_bank_candidate")
    payload = V.payload_id("pkg_", {"stage": F.col("source_stage"), "area": F.col("area"), "answer": F.col("answer")})
    candidate = F.concat(F.lit("qbc_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source_stage", "package_id", "validation_package_id", "stem")]), 256), 1, 20))
    scope = V.id_or_hash(F.col("scope_id"), F.col("subject"), F.col("field"), F.col("area"), F.col("detail"))
    return rows.select("id", payload.alias("payload"), V.slug_id("obj_", F.col("subject"), F.col("area")).alias("slug"), candidate.alias("candidate"), scope.alias("scope"), F.sha2("stem", 256).alias("whole")).distinct()


def long_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "question_bank_candidate").filter("answer between 1 and 5")
    return rows.filter(V.stands_out(_options(), F.col("answer"), 1.3, 20)).select("id").distinct()


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").select("vec_id", V.unit_vector(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


def subject_periods(spark: SparkSession, d: str) -> DataFrame:
    """The period of each candidate's subject by the scope list, and whether the candidate says another."""
    known = read_table(spark, d, "exam_scope").groupBy("subject").agg(F.min("period").alias("listed"))
    rows = _once(spark, d, "question_bank_candidate").join(small(known), "subject", "left")
    return rows.groupBy("subject", "listed").agg(F.count("*").alias("n"), F.count_if(~F.col("period").eqNullSafe(F.col("listed"))).alias("other"))


def time_forms(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("created")
    return read_table(spark, d, "source_document").select(
        "id", D.iso(at).alias("iso"), D.iso(at, False).alias("seconds"), D.run_id(at).alias("run"), D.local(at, "Asia/Seoul").alias("seoul"), D.day(at).alias("day"),
        D.day(D.midnight(F.col("updated"))).alias("began"), D.day(D.parsed_day(F.col("reference_date"))).alias("reference"),
    )


def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the validation summaries; broken and blank text counts as a score of -1."""
    score = V.json_or(F.col("summary_json"), "struct<score:double>", F.struct(F.lit(-1.0).alias("score")))
    rows = _once(spark, d, "question_bank_candidate_validation")
    return rows.select("id", F.coalesce(score["score"], F.lit(-1.0)).alias("score"))


def option_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "question_bank_candidate").withColumn("o", V.option_list(F.col("options_json")))
    return rows.select("id", F.size("o").alias("n"), V.option_at(F.col("o"), F.col("answer")).alias("chosen"), V.option_at(F.col("o"), F.lit(9)).alias("beyond"))


def answer_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many answers the stored value, and forms made of it, name."""
    rows = _once(spark, d, "question_bank_candidate").select("id", "answer", _options().alias("o"))
    plain, listed = F.col("answer").cast("string"), F.concat(F.lit("["), F.col("answer").cast("string"), F.lit(", 2]"))
    counted = {"plain": plain, "listed": listed, "joined": F.concat(F.lit('"1, '), F.col("answer").cast("string"), F.lit('"')), "blank": F.lit(" ")}
    return rows.select("id", *[V.answer_count(c, F.col("o")).alias(n) for n, c in counted.items()])


def reference_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the candidate's list and of its evidence rows, each once, in this order."""
    rows = _once(spark, d, "question_bank_candidate").select("id", V.string_list(F.col("evidence_refs_json")).alias("own"))
    evidence = _once(spark, d, "question_bank_candidate_evidence").groupBy(F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "rag_input_id"))).alias("e"))
    joined = rows.join(evidence, "id", "left")
    return joined.select("id", F.array_join(V.merged_ids(F.col("own"), F.transform("e", lambda x: x["rag_input_id"])), ",").alias("refs"))


CHECKS = ("fact", "scope", "style")


def verdict_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of one check made of each validation row, brought into the full form."""
    rows = _once(spark, d, "question_bank_candidate_validation")
    said = F.to_json(F.struct(F.col("verdict").alias("overall_verdict"), F.create_map(F.lit("fact"), F.struct(F.col("verdict").alias("verdict"), F.col("validator_type").alias("reason"))).alias("checks"), F.lit("").alias("notes")))
    fixed = V.normalized_verdict(F.when(F.col("passed") == 1, said).otherwise(F.col("summary_json")), ("pass", "revise", "reject"), CHECKS, "revise", "missing", "no reason")
    made = rows.select("id", fixed.alias("v"))
    return made.select("id", F.col("v.verdict").alias("verdict"), F.col("v.revision_required").alias("required"), F.array_join(V.failed_checks(F.col("v.checks")), ",").alias("failed"), F.size("v.errors").alias("errors"))


def relocated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers moved to the place their id's hash gives, the other options drawn from the id."""
    rows = _once(spark, d, "question_bank_candidate").filter("answer between 1 and 5")
    target = (V.hash_modulo(F.col("id"), 5) + 1).alias("target")
    moved = rows.select("id", "answer", target, _options().alias("o")).withColumn("m", V.relocated("o", "answer", "target", "id"))
    return moved.select("id", "target", F.element_at("m", F.col("target")).alias("answer_text"), F.array_join(F.array_sort("m"), "|").alias("options"))


def payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """Payloads read as objects, a field set in place, written again."""
    held = V.json_or(F.col("candidate_payload_json"), "struct<v:int,note:string>", F.struct(F.lit(0).alias("v"), F.lit(None).cast("string").alias("note")))
    rows = _once(spark, d, "question_bank_candidate")
    return rows.select("id", F.to_json(held.withField("note", F.coalesce(V.none_if_blank(F.col("status")), F.lit("none")))).alias("payload"))


QUERIES = {
    f.__name__: f
    for f in (
        excerpt_sizes, composed_keys, page_cleaning, word_sets, boosted_scores, containment_match, window_similarities, paragraph_pieces, file_slugs, option_tables, level_markers, keyword_pages, unit_numbers,
        made_ids, long_answers, unit_vectors, subject_periods, time_forms, json_defaults, option_lists, answer_counts, reference_ids, verdict_repairs, relocated_answers, payload_fields,
    )
}

_C = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate)"
_E = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_evidence)"
_V = "(SELECT DISTINCT ON (id) * FROM question_bank_candidate_validation)"
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"
_NUMBERED = r"regexp_replace({0}, '^\s*(?:no\.?\s*[0-9]+[.)]?|#\s*[0-9]+|[(][0-9]+[)]|[0-9]+(?:\.[0-9]+)+[.)]?|[0-9]+[.)]|[ivx]+[.)])\s*', '', 'i')"
_KEY = "lower(regexp_replace({0}, '[^0-9A-Za-z가-힣]+', '', 'g'))"
_PAGE = r"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(content), '[ \t\x0B\f\r\x{A0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')"
_CUT = "regexp_replace(t, '^(.+?)(으로부터|으로써|에서|으로|에게|부터|까지|에는|의|을|를|은|는|이|가|과|와|도|만|에|로)$', '\\1')"
_FIVE = "[coalesce(option_1, ''), coalesce(option_2, ''), coalesce(option_3, ''), coalesce(option_4, ''), coalesce(option_5, '')]"
_UNITS = r"list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?\s*(?:%|[A-Za-zμ°]+(?:/[A-Za-z]+)?)?'), lambda v: regexp_replace(v, '\s+', '', 'g')))"
_BOOSTS = "list_filter(string_split_regex(replace(mapped_area, ',', ' '), '\\s+'), lambda t, i: length(t) >= 2 AND list_position(string_split_regex(replace(mapped_area, ',', ' '), '\\s+'), t) = i)"

SQL = {
    "excerpt_sizes": f"""WITH t AS (SELECT rag_input_id, {_FLAT.format('content')} AS c FROM chunks)
        SELECT DISTINCT rag_input_id, sha256(CASE WHEN length(c) > 320 THEN rtrim(left(c, 320), ' ') || '...' ELSE c END) AS e320, sha256(CASE WHEN length(c) > 700 THEN rtrim(left(c, 700), ' ') || '...' ELSE c END) AS e700,
        sha256(CASE WHEN length(c) > 240 THEN rtrim(left(c, 239), ' ') || '…' ELSE c END) AS within FROM t""",
    "composed_keys": f"SELECT {_KEY.format(_NUMBERED.format('nfc_normalize(mapped_detail)'))} AS detail_key, count(*) AS n FROM chunks WHERE mapped_detail IS NOT NULL GROUP BY 1",
    "page_cleaning": f"SELECT DISTINCT id, sha256({_PAGE}) AS page, sha256({_FLAT.format(_PAGE)}) AS cell FROM source_chunk WHERE content IS NOT NULL",
    "word_sets": f"""SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(stem), '[0-9a-z가-힣]+'), lambda t: {_CUT}),
        lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ('옳은', '것은', '대한', '관한')))), ' ') AS words FROM question_bank_candidate WHERE stem IS NOT NULL""",
    "boosted_scores": f"""SELECT DISTINCT rag_input_id, round(least(0.12, 0.05 * len(list_filter({_BOOSTS}, lambda t: contains(concat_ws(' ', content, excerpt, metadata_json), t)))), 4)::DOUBLE AS boost,
        array_to_string(list_transform({_BOOSTS}, lambda t: '"' || t || '"'), ' OR ') AS query FROM chunks WHERE mapped_area IS NOT NULL AND content IS NOT NULL""",
    "containment_match": f"""WITH t AS (SELECT DISTINCT mapped_area, mapped_detail, {_KEY.format('mapped_detail')} AS k FROM chunks WHERE mapped_area IS NOT NULL AND mapped_detail IS NOT NULL),
        s AS (SELECT area, id, {_KEY.format('detail')} AS k FROM exam_scope)
        SELECT mapped_area, mapped_detail, s.id AS scope_id FROM t JOIN s ON area = mapped_area WHERE t.k <> '' AND s.k <> '' AND (contains(t.k, s.k) OR contains(s.k, t.k))""",
    "file_slugs": r"""SELECT id, left(regexp_replace(regexp_replace(concat_ws(' ', title, filename), '[^0-9A-Za-z가-힣._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS slug,
        '&lt;b&gt;' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '&lt;/b&gt;' AS shown, printf('%08d', page_count) AS padded, format('{:,}', page_count * 1000) AS thousands FROM source_document""",
    "level_markers": """SELECT DISTINCT id, (['A', 'B', NULL])[answer % 3 + 1] AS level, trim(regexp_replace('(가) ' || CASE WHEN answer % 3 = 2 THEN '(D) ' ELSE '' END || coalesce(option_1, ''), '\\s+', ' ', 'g'), ' ') AS rest
        FROM question_bank_candidate WHERE answer BETWEEN 0 AND 9""",
    "keyword_pages": "SELECT DISTINCT id, array_to_string(list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "], lambda k: contains(content, k)), ',') AS hits, sha256(left(content, 600)) AS head FROM source_chunk WHERE "
    + " OR ".join(f"contains(content, '{k}')" for k in KEYWORDS),
    "unit_numbers": f"""WITH s AS (SELECT DISTINCT id AS candidate_id, unnest({_UNITS.format('explanation')}) AS number FROM question_bank_candidate), c AS (SELECT DISTINCT rag_input_id, unnest({_UNITS.format('content')}) AS number FROM chunks),
        t AS (SELECT DISTINCT e.candidate_id, c.number FROM question_bank_candidate_evidence e JOIN c USING (rag_input_id))
        SELECT candidate_id, number FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.candidate_id = s.candidate_id AND t.number = s.number)""",
    "made_ids": """SELECT DISTINCT id, 'pkg_' || left(sha256('{"answer": ' || coalesce(CAST(answer AS VARCHAR), 'null') || ', "area": ' || coalesce(CAST(to_json(area) AS VARCHAR), 'null') || ', "stage": ' || coalesce(CAST(to_json(source_stage) AS VARCHAR), 'null') || '}'), 16) AS payload,
        'obj_' || left(sha1(coalesce(subject, '') || '|' || coalesce(area, '')), 10) AS slug, 'qbc_' || left(sha256(coalesce(source_stage, '') || '|' || coalesce(package_id, '') || '|' || coalesce(validation_package_id, '') || '|' || coalesce(stem, '')), 20) AS candidate,
        CASE WHEN trim(scope_id, ' ') <> '' THEN scope_id ELSE 'scope-' || left(sha256(coalesce(subject, '') || '::' || coalesce(field, '') || '::' || coalesce(area, '') || '::' || coalesce(detail, '')), 12) END AS scope, sha256(stem) AS whole FROM question_bank_candidate""",
    "long_answers": f"""WITH t AS (SELECT id, answer, list_transform({_FIVE}, lambda o: length(o)) AS n FROM question_bank_candidate WHERE answer BETWEEN 1 AND 5)
        SELECT DISTINCT id FROM t WHERE n[answer] > 20 AND n[answer] > 1.3 * (list_sum(n) - n[answer]) / 4.0""",
    "unit_vectors": """WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM t)
        SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda v: v / n)), 5) AS total FROM u""",
    "subject_periods": f"""SELECT c.subject, s.listed, count(*) AS n, count(*) FILTER (period IS DISTINCT FROM listed) AS other FROM {_C} c LEFT JOIN (SELECT subject, min(period) AS listed FROM exam_scope GROUP BY 1) s ON s.subject = c.subject GROUP BY ALL""",
    "time_forms": r"""SELECT id, strftime(created, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(created) % 1000000 = 0 THEN '' ELSE strftime(created, '.%f') END || '+00:00' AS iso, strftime(created, '%Y-%m-%dT%H:%M:%S+00:00') AS seconds, strftime(created, '%Y%m%dT%H%M%SZ') AS run,
        strftime(created + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS seoul, strftime(created, '%Y-%m-%d') AS day, strftime(updated, '%Y-%m-%d') AS began,
        strftime(TRY_CAST(CASE WHEN regexp_full_match(r, '[0-9]{8}') THEN left(r, 4) || '-' || r[5:6] || '-' || r[7:8] WHEN regexp_full_match(r, '[0-9]{4}-[0-9]{1,2}') THEN r || '-1' WHEN regexp_full_match(r, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN r WHEN regexp_full_match(r, '[0-9]{4}') THEN r || '-1-1' END AS DATE), '%Y-%m-%d') AS reference
        FROM (SELECT *, regexp_replace(trim(reference_date, ' '), '[./]\s*', '-', 'g') AS r FROM source_document)""",
    "json_defaults": f"SELECT id, coalesce(CASE WHEN json_valid(summary_json) THEN CAST(json_extract_string(summary_json, '$.score') AS DOUBLE) END, -1.0) AS score FROM {_V}",
    "option_lists": f"""WITH t AS (SELECT *, CASE WHEN json_valid(options_json) THEN json_extract_string(options_json, '$[*]') ELSE [] END AS o FROM {_C})
        SELECT id, CAST(len(o) AS INT) AS n, CASE WHEN answer >= 1 THEN coalesce(o[answer], '') ELSE '' END AS chosen, '' AS beyond FROM t""",
    "answer_counts": f"""SELECT id, CASE WHEN answer BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS plain, CASE WHEN answer IS NULL THEN 0 ELSE 2 END AS listed, CASE WHEN answer IS NULL THEN 0 ELSE 2 END AS joined, 0 AS blank FROM {_C}""",
    "reference_ids": f"""WITH e AS (SELECT candidate_id, list(rag_input_id ORDER BY id) AS r FROM {_E} GROUP BY 1),
        t AS (SELECT c.id, list_concat(CASE WHEN json_valid(evidence_refs_json) THEN json_extract_string(evidence_refs_json, '$[*]') ELSE [] END, coalesce(e.r, [])) AS l FROM {_C} c LEFT JOIN e ON e.candidate_id = c.id)
        SELECT id, array_to_string(list_filter(list_filter(l, lambda x: x IS NOT NULL), lambda x, i: trim(x, ' ') <> '' AND list_position(list_filter(l, lambda y: y IS NOT NULL), x) = i), ',') AS refs FROM t""",
    "verdict_repairs": f"""WITH t AS (SELECT id, passed, CASE WHEN passed = 1 AND verdict IN ('pass', 'revise', 'reject') THEN verdict END AS v, passed = 1 AS made, validator_type AS r FROM {_V})
        SELECT id, coalesce(v, 'revise') AS verdict, coalesce(v, 'revise') <> 'pass' AS required,
        CASE WHEN coalesce(v, 'revise') <> 'pass' OR v IS NULL THEN 'fact,scope,style' ELSE 'scope,style' END AS failed,
        CAST((CASE WHEN v IS NULL THEN 1 ELSE 0 END) + (CASE WHEN made THEN (CASE WHEN v IS NULL THEN 1 ELSE 0 END) + (CASE WHEN coalesce(trim(r, ' '), '') = '' THEN 1 ELSE 0 END) + 2 ELSE 5 END) AS INT) AS errors FROM t""",
    "relocated_answers": f"""SELECT id, CAST(('0x' || left(sha256(id), 16))::UBIGINT % 5 + 1 AS INT) AS target, ({_FIVE})[answer] AS answer_text, array_to_string(list_sort({_FIVE}), '|') AS options FROM {_C} WHERE answer BETWEEN 1 AND 5""",
    "payload_fields": f"""SELECT id, '{{' || CASE WHEN json_extract_string(candidate_payload_json, '$.v') IS NULL THEN '' ELSE '"v":' || json_extract_string(candidate_payload_json, '$.v') || ',' END || '"note":"' || CASE WHEN trim(status, ' ') <> '' THEN status ELSE 'none' END || '"}}' AS payload FROM {_C}""",
}
# Distinct labels in their order: list functions of the compared engine don't keep it, so each place looks at those before.
_LABEL = f"list_filter(list_transform({_FIVE}, lambda o: left({_FLAT.format('o')}, 10)), lambda v: v <> '')"
SQL["option_tables"] = rf"""WITH t AS (SELECT id, {_FIVE} AS f, {_LABEL} AS l FROM question_bank_candidate)
    SELECT DISTINCT id, '| ' || array_to_string(list_transform(f, lambda o: replace({_FLAT.format('o')}, '|', '\|')), ' | ') || ' |' AS line, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:3], '|') AS labels FROM t"""
