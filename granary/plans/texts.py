"""Text, id and gate queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import values as V
from granary.operators import gates
from granary.sources.tables import read_table

# Families of wording that hold a passage back, tried in this order.
HOLDS = (
    ("hold_legal_or_statutory", r"제\s*\d+\s*조|별표|시행규칙|시행령|의료법|모자보건법|지역보건법|원자력안전법|의료기사\s*등에\s*관한\s*법률|진단용\s*방사선\s*발생장치.*안전관리|질병관리청|식품의약품안전처|보건복지부"),
    ("hold_visual_caption", r"(?:그림|표)\s*[0-9]+|(?<![\p{L}\p{N}_])(?:fig|table)\.?\s*[0-9]+"),
    ("hold_formula_or_equation", r"수식|공식|방정식|[A-Za-zηλμρσθ]\s*=|\d+(?:\.\d+)?\s*[×x]\s*10\s*[-−^]?\s*\d+"),
    ("hold_numeric_unit", r"(?<![\p{L}\p{N}_])\d+(?:\.\d+)?\s*(?:kV|mA|mAs|Gy|Sv|Bq|keV|MeV|MHz|mmHg|mGy|mSv|MBq|GBq)(?![\p{L}\p{N}_])"),
)
TEXT_METHODS = ("text", "ocr")


def chunk_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", X.clean_lines(F.col("text")).alias("t"))
    pieces = rows.select("doc_id", F.posexplode(X.sliding_chunks(F.col("t"))).alias("chunk_index", "content"))
    return pieces.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), V.stable_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").select("rag_input_id", X.excerpt(F.col("content"), 360).alias("excerpt_360")).distinct()


def compact_keys(spark: SparkSession, d: str) -> DataFrame:
    areas = read_table(spark, d, "chunks").filter("mapped_area is not null")
    return areas.groupBy(X.compact_key(X.without_numbering(F.col("mapped_area"))).alias("area_key")).agg(F.count("*").alias("n"), F.count_distinct("mapped_area").alias("spellings"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks").select("rag_input_id", X.tokens(F.col("content")).alias("t")).filter("t is not null")
    return rows.select("rag_input_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct")).distinct()


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "question_bank_candidate").filter("explanation is not null").select("id", X.sentences(F.col("explanation")).alias("s"))
    return rows.select("id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest")).distinct()


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks")
    made = V.stable_id(F.col("source_file"), F.col("page_or_slide"), F.col("source_chunk_id"), length=20)
    return rows.select("rag_input_id", F.concat(F.lit("rag_input_"), made).alias("made_id")).distinct()


def hash_modulo(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "question_bank_candidate").select("id").distinct()
    return rows.groupBy((V.hash_modulo(F.col("id"), 5) + 1).alias("target_answer")).agg(F.count("*").alias("n"))


def json_payload_extract(spark: SparkSession, d: str) -> DataFrame:
    method = F.get_json_object("metadata_json", "$.extraction_method")
    return read_table(spark, d, "chunks").groupBy(F.coalesce(method, F.lit("missing")).alias("method")).agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"))


def content_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "source_chunk").withColumn("c", F.coalesce("content", F.lit("")))
    banded = rows.withColumn("quality", gates.quality_band(F.length("c")))
    classed = banded.withColumn("page_class", gates.page_class(F.col("page_start"), F.col("c"), F.col("quality")))
    tokens = F.greatest(F.lit(1), F.floor(F.length("c") / 3))
    return classed.groupBy("quality", "page_class").agg(F.count("*").alias("n"), F.sum(tokens).cast("bigint").alias("tokens"))


def _holds(text) -> gates.Checks:
    return [(name, text.rlike(f"(?iU){pattern}")) for name, pattern in HOLDS]


def _admission(spark: SparkSession, d: str) -> tuple[DataFrame, gates.Checks]:
    """Eight flags, then four families of wording."""
    text = F.coalesce("content", F.lit(""))
    checks = [
        ("empty_content", text == ""),
        ("not_approved_for_rag_evidence", ~F.coalesce(F.col("approved_for_rag_evidence") == 1, F.lit(False))),
        ("not_ready_for_rag_evidence", ~F.coalesce(F.col("candidate_rag_status") == "ready_for_rag_evidence", F.lit(False))),
        ("generation_approved_unexpected", F.coalesce(F.col("approved_for_generation") == 1, F.lit(False))),
        ("non_text_chunk_type", ~F.coalesce(F.get_json_object("metadata_json", "$.extraction_method").isin(*TEXT_METHODS), F.lit(False))),
        ("non_high_quality", ~F.coalesce(F.col("extraction_quality") == "high", F.lit(False))),
        ("source_needs_review", F.coalesce(F.col("scope_mapping_needs_review") == 1, F.lit(False))),
        ("source_path_missing", F.coalesce(F.trim("source_path"), F.lit("")) == ""),
        *_holds(text),
    ]
    return read_table(spark, d, "chunks"), checks


def gate_first_reason(spark: SparkSession, d: str) -> DataFrame:
    rows, checks = _admission(spark, d)
    return rows.groupBy(gates.first_reason(checks, "included").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("rag_input_id").alias("ids"))


def gate_all_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows, checks = _admission(spark, d)
    return rows.select("rag_input_id", F.array_join(gates.all_reasons(checks), ",").alias("reasons")).distinct()


def duplicate_options(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "question_bank_candidate")
    options = F.posexplode(F.array(*[F.col(f"option_{i}") for i in range(1, 6)])).alias("place", "option")
    each = rows.select("id", options).withColumn("k", F.lower(X.collapsed(F.coalesce("option", F.lit(""))))).filter("k <> ''").distinct()
    return each.groupBy("id", "k").agg(F.count_distinct("place").alias("places")).filter("places > 1").select("id", F.col("k").alias("option_key"), "places")


def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a stem that stand in no content of the candidate's evidence chunks."""
    stems = read_table(spark, d, "question_bank_candidate").select(F.col("id").alias("candidate_id"), F.explode(X.numbers(F.col("stem"))).alias("number")).distinct()
    evidence = read_table(spark, d, "question_bank_candidate_evidence").select("candidate_id", "rag_input_id").dropna().distinct()
    chunks = read_table(spark, d, "chunks").select("rag_input_id", F.explode(X.numbers(F.col("content"))).alias("number")).distinct()
    there = evidence.join(chunks, "rag_input_id").select("candidate_id", "number").distinct()
    return stems.join(there, ["candidate_id", "number"], "left_anti")


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Explanation against its evidence chunk by matching blocks, every pair; 1 where the chunk contains the explanation."""
    candidates = read_table(spark, d, "question_bank_candidate").select(F.col("id").alias("candidate_id"), X.collapsed(F.col("explanation")).alias("a")).dropna().dropDuplicates(["candidate_id"])
    evidence = read_table(spark, d, "question_bank_candidate_evidence").select("candidate_id", "rag_input_id").dropna().distinct()
    chunks = read_table(spark, d, "chunks").select("rag_input_id", X.collapsed(F.col("content")).alias("b")).dropna().dropDuplicates(["rag_input_id"])
    pairs = candidates.join(evidence, "candidate_id").join(chunks, "rag_input_id")
    contained = X.contains_text(F.col("a"), F.col("b"))
    compared = X.sequence_ratio(F.when(~contained, F.col("a")), F.when(~contained, F.col("b")))
    return pairs.select("candidate_id", "rag_input_id", F.round(F.when(contained, 1.0).otherwise(compared), 6).alias("ratio"))


def semantic_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks").filter("content is not null").select("rag_input_id", "content").distinct()
    return rows.select("rag_input_id", F.posexplode(X.semantic_segments()("content")).alias("segment", "text"))


def display_shuffle_grade(spark: SparkSession, d: str) -> DataFrame:
    """Where the stored answer stands in the shuffled options of a fixed session."""
    rows = read_table(spark, d, "question_bank_candidate").filter("answer between 1 and 5").select("id", "answer").distinct()
    order = V.display_order(F.lit("session-1"), F.col("id"), F.lit(5))
    return rows.select("id", "answer", F.array_position(order, F.col("answer") - 1).cast("int").alias("shown_at"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_sliding, excerpts, compact_keys, token_stats, sentence_split, stable_ids, hash_modulo, json_payload_extract, content_quality,
        gate_first_reason, gate_all_reasons, duplicate_options, unsupported_numbers, similarity_pairs, semantic_segments, display_shuffle_grade,
    )
}

_BLANK = r"[ \t\r\f\x0B\x{00A0}\x{2007}\x{202F}\x{3000}]+"
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+'))"
# Written on their own: the regular expressions of the compared engine know word bounds of ASCII only.
_CHECKS = [
    ("empty_content", "coalesce(content, '') = ''"), ("not_approved_for_rag_evidence", "approved_for_rag_evidence IS DISTINCT FROM 1"), ("not_ready_for_rag_evidence", "candidate_rag_status IS DISTINCT FROM 'ready_for_rag_evidence'"),
    ("generation_approved_unexpected", "approved_for_generation IS NOT DISTINCT FROM 1"), ("non_text_chunk_type", "coalesce(json_extract_string(metadata_json, '$.extraction_method') NOT IN ('text', 'ocr'), true)"),
    ("non_high_quality", "extraction_quality IS DISTINCT FROM 'high'"), ("source_needs_review", "scope_mapping_needs_review IS NOT DISTINCT FROM 1"), ("source_path_missing", "coalesce(trim(source_path, ' '), '') = ''"),
    ("hold_legal_or_statutory", r"regexp_matches(coalesce(content, ''), '제[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*조|별표|시행(규칙|령)|(의료|모자보건|지역보건|원자력안전)법|의료기사[\s\p{Z}]*등에[\s\p{Z}]*관한[\s\p{Z}]*법률|진단용[\s\p{Z}]*방사선[\s\p{Z}]*발생장치.*안전관리|질병관리청|식품의약품안전처|보건복지부')"),
    ("hold_visual_caption", r"regexp_matches(coalesce(content, ''), '(그림|표)[\s\p{Z}]*[0-9]|(^|[^\p{L}\p{N}_])(fig|table)[.]?[\s\p{Z}]*[0-9]', 'i')"),
    ("hold_formula_or_equation", r"regexp_matches(coalesce(content, ''), '수식|공식|방정식|[a-zηλμρσθ][\s\p{Z}]*=|\p{Nd}[\s\p{Z}]*[×x][\s\p{Z}]*10[\s\p{Z}]*[-−^]?[\s\p{Z}]*\p{Nd}', 'i')"),
    ("hold_numeric_unit", r"regexp_matches(coalesce(content, ''), '(^|[^\p{L}\p{N}_])\p{Nd}+(\.\p{Nd}+)?[\s\p{Z}]*(kV|mAs?|[mMG]?(Gy|Sv|Bq)|[kM]eV|MHz|mmHg)($|[^\p{L}\p{N}_])', 'i')"),
]
_NUMBERS = r"list_distinct(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'))"

SQL = {
    "chunk_sliding": rf"""
        WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '{_BLANK}', ' ', 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10)) AS t FROM documents),
        p AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 1400 THEN 1 ELSE 1 + CAST(ceil((length(t) - 1400) / 1220.0) AS INT) END)) AS i FROM t WHERE length(t) > 0),
        c AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, trim(substring(t, CAST(i AS INT) * 1220 + 1, 1400), ' ') AS content FROM p)
        SELECT doc_id, chunk_index, CAST(length(content) AS INT) AS n_chars, substring(sha256(doc_id || '::' || chunk_index || '::' || content), 1, 16) AS chunk_id FROM c""",
    "excerpts": r"""
        WITH t AS (SELECT rag_input_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS c FROM chunks)
        SELECT DISTINCT rag_input_id, CASE WHEN length(c) > 360 THEN rtrim(substring(c, 1, 360), ' ') || '...' ELSE c END AS excerpt_360 FROM t""",
    "compact_keys": r"""
        SELECT lower(regexp_replace(regexp_replace(mapped_area, '^\s*(?:\d+(?:\.\d+)*[.)]|[(]\d+[)]|#\d+)\s*', ''), '[^0-9A-Za-z가-힣]+', '', 'g')) AS area_key, count(*) AS n, count(DISTINCT mapped_area) AS spellings
        FROM chunks WHERE mapped_area IS NOT NULL GROUP BY 1""",
    "token_stats": f"""
        WITH t AS (SELECT rag_input_id, {_TOKENS.format('content')} AS t FROM chunks WHERE content IS NOT NULL)
        SELECT DISTINCT rag_input_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM t""",
    "sentence_split": r"""
        WITH t AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(explanation, '([.!?。])\s+', '\1' || chr(1), 'g'), '[;；]', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s
                   FROM question_bank_candidate WHERE explanation IS NOT NULL)
        SELECT DISTINCT id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS longest FROM t""",
    "stable_ids": """
        SELECT DISTINCT rag_input_id, 'rag_input_' || substring(sha256(coalesce(source_file, '') || '::' || coalesce(CAST(page_or_slide AS VARCHAR), '') || '::' || coalesce(source_chunk_id, '')), 1, 20) AS made_id FROM chunks""",
    "hash_modulo": """
        SELECT CAST(('0x' || substring(sha256(id), 1, 16))::UBIGINT % 5 + 1 AS INT) AS target_answer, count(*) AS n FROM (SELECT DISTINCT id FROM question_bank_candidate) GROUP BY 1""",
    "json_payload_extract": """
        SELECT coalesce(json_extract_string(metadata_json, '$.extraction_method'), 'missing') AS method, count(*) AS n, count(DISTINCT source_file) AS files FROM chunks GROUP BY 1""",
    "content_quality": """
        WITH t AS (SELECT coalesce(content, '') AS c, page_start FROM source_chunk),
        q AS (SELECT *, CASE WHEN length(c) >= 500 THEN 'high' WHEN length(c) >= 120 THEN 'medium' ELSE 'low' END AS quality FROM t),
        p AS (SELECT *, CASE WHEN length(trim(c, ' ')) < 40 THEN 'blank' WHEN page_start <= 8 AND regexp_matches(c, '목차|머리말|판권|차례') THEN 'front_matter' WHEN quality = 'low' THEN 'low_quality' ELSE 'body' END AS page_class FROM q)
        SELECT quality, page_class, count(*) AS n, CAST(sum(greatest(1, length(c) // 3)) AS BIGINT) AS tokens FROM p GROUP BY ALL""",
    "gate_first_reason": "SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _CHECKS) + " ELSE 'included' END AS reason, count(*) AS n, count(DISTINCT rag_input_id) AS ids FROM chunks GROUP BY 1",
    "gate_all_reasons": "SELECT DISTINCT rag_input_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CHECKS) + "], lambda x: x IS NOT NULL)), ',') AS reasons FROM chunks",
    "duplicate_options": r"""
        WITH o AS (SELECT id, unnest([option_1, option_2, option_3, option_4, option_5]) AS option, unnest([1, 2, 3, 4, 5]) AS place FROM question_bank_candidate),
        k AS (SELECT DISTINCT id, place, lower(trim(regexp_replace(coalesce(option, ''), '\s+', ' ', 'g'), ' ')) AS k FROM o)
        SELECT id, k AS option_key, count(DISTINCT place) AS places FROM k WHERE k <> '' GROUP BY id, k HAVING count(DISTINCT place) > 1""",
    "unsupported_numbers": f"""
        WITH s AS (SELECT DISTINCT id AS candidate_id, unnest({_NUMBERS.format('stem')}) AS number FROM question_bank_candidate),
        c AS (SELECT DISTINCT rag_input_id, unnest({_NUMBERS.format('content')}) AS number FROM chunks),
        t AS (SELECT DISTINCT e.candidate_id, c.number FROM question_bank_candidate_evidence e JOIN c USING (rag_input_id))
        SELECT candidate_id, number FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.candidate_id = s.candidate_id AND t.number = s.number)""",
}
