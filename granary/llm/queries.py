"""The pN_ queries: (spark, data directory) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import canonical_list, leakage, links, lookalikes, near_duplicates, packing, pair_defects, scans, shared_spans, splitting, subjects
from granary.sources.tables import read_table


P1_TEXT = ["stem", "option_1", "explanation"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = near_duplicates.near_duplicates(read_table(spark, d, "question_bank_candidate"), "id", P1_TEXT)
    return near_duplicates.expanded_links(members, pairs)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with the least id of its group of similar ones (its own where it has none) and its class."""
    members, pairs = near_duplicates.near_duplicates(read_table(spark, d, "question_bank_candidate"), "id", P1_TEXT)
    groups = links.connected_components(pairs, "id_a", "id_b").select(F.col("id").alias("representative"), "group")
    joined = members.join(groups.hint("merge"), "representative", "left")
    return joined.select("id", F.col("representative").alias("class_id"), F.coalesce("group", "representative").alias("group_id"))


def _text_fields(spark: SparkSession, d: str) -> DataFrame:
    chunks, scope = read_table(spark, d, "chunks"), read_table(spark, d, "exam_scope")
    fields = F.explode(
        F.array(
            F.struct(F.lit("content").alias("field_name"), F.col("content").alias("value")),
            F.struct(F.lit("mapped_detail").alias("field_name"), F.col("mapped_detail").alias("value")),
        )
    ).alias("f")
    of_chunks = chunks.select(F.lit("chunks").alias("table_name"), F.col("rag_input_id").alias("record_id"), fields)
    of_scope = scope.select(F.lit("exam_scope").alias("table_name"), F.col("id").alias("record_id"), F.lit("detail").alias("field_name"), F.col("detail").alias("value"))
    return of_chunks.select("table_name", "record_id", "f.field_name", "f.value").unionByName(of_scope)


P2_KEY = ["table_name", "record_id", "field_name"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_forms(_text_fields(spark, d), P2_KEY, "value", only_changed=True).select(*P2_KEY).distinct()


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_forms(_text_fields(spark, d), P2_KEY, "value")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, d, "source_chunk"), "id", "content", "page_start", "page_end").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(read_table(spark, d, "source_chunk"), "id", "content", "page_start", "page_end")
    return pieces.filter("piece > 0").select("id").distinct()


OPTIONS = [f"option_{i}" for i in range(1, 6)]


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    found = pair_defects.pair_defects(read_table(spark, d, "question_bank_candidate"), "id", "stem", "explanation", "answer", OPTIONS)
    return found.select("id", F.explode("defects").alias("defect")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = pair_defects.pair_defects(read_table(spark, d, "question_bank_candidate"), "id", "stem", "explanation", "answer", OPTIONS)
    return found.select("id", "defect").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks, scope = read_table(spark, d, "chunks"), read_table(spark, d, "exam_scope")
    areas = canonical_list.map_to_list(chunks, ["rag_input_id"], "mapped_area", scope.select("area", F.col("area").alias("name")), "area", "name")
    details = canonical_list.map_to_list(chunks, ["rag_input_id"], "mapped_detail", scope, "id", "detail")
    listed_areas = canonical_list.listed_names(scope, "area")
    listed_details = [canonical_list.consistent(n) for n in canonical_list.listed_names(scope, "detail")]
    found = None
    for field, rows, listed in (("mapped_area", areas, listed_areas), ("mapped_detail", details, listed_details)):
        rows = rows.filter(F.col("canonical_key").isNotNull() & ~F.col("value").isin(listed))
        rows = rows.select("rag_input_id", F.lit(field).alias("field_name"), "canonical_key")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _passage_fields(spark: SparkSession, d: str) -> DataFrame:
    candidates, chunks = read_table(spark, d, "question_bank_candidate"), read_table(spark, d, "chunks")
    parts = [
        rows.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.lit(field).alias("field_name"), F.col(field).alias("text"))
        for rows, table, key, field in (
            (candidates, "question_bank_candidate", "id", "stem"),
            (candidates, "question_bank_candidate", "id", "explanation"),
            (chunks, "chunks", "rag_input_id", "content"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


P7_RECORD = ["table_name", "record_id"]
P7_KEY = [*P7_RECORD, "field_name"]


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_passage_fields(spark, d), P7_KEY, P7_RECORD, "text", passage_column="passage")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.covered_shares(_passage_fields(spark, d), P7_KEY, P7_RECORD, "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).filter("covered > 0").select(*P7_RECORD)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_items(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "item_text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "run", "share")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents with a window like one of an item, those with an equal run of 100 letters and digits."""
    return p9_leaks(spark, d).filter("run >= 100").select("doc_id", "item_id").distinct()


def p10_mixtures(spark: SparkSession, d: str) -> DataFrame:
    areas, labels = read_table(spark, d, "subject_areas"), read_table(spark, d, "area_labels")
    described = areas.select("area_code", F.concat_ws(", ", "description", "area_name", "area_name_en").alias("description"))
    found = subjects.subject_mixtures(read_table(spark, d, "documents"), "doc_id", "text", described, "area_code", "description", labels, "doc_id", "area_code")
    return found.select(F.col("id").alias("doc_id"), F.col("area").alias("area_code"), "share")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_mixtures(spark, d).filter(F.col("share") >= 0.25 - 1e-9).select("doc_id", "area_code").distinct()


def _scan_texts(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Contents of both tables, and the section names that running headers carry (from the fixed dimension tables)."""
    chunks, source = read_table(spark, d, "chunks"), read_table(spark, d, "source_chunk")
    rows = source.select(F.lit("source_chunk").alias("table_name"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    rows = rows.unionByName(chunks.select(F.lit("chunks").alias("table_name"), F.col("rag_input_id").alias("record_id"), F.col("content").alias("text")))
    scope, codes = read_table(spark, d, "exam_scope"), read_table(spark, d, "subject_areas")
    names = scope.select(F.explode(F.array("area", "field")).alias("n")).union(codes.select(F.upper("area_code"))).distinct()
    return rows, [r.n for r in names.collect() if r.n]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, sections = _scan_texts(spark, d)
    return scans.scanned_rows(rows, ["table_name", "record_id"], "text", sections)


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    rows, sections = _scan_texts(spark, d)
    return scans.repaired_texts(rows, ["table_name", "record_id"], "text", sections)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from granary.llm import sql

    return sql.SQL
