"""Queries that find nothing in the given tables, on tables where they do."""

from granary.plans import registry


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_options_repeated_in_one_candidate(spark, tmp_path):
    columns = ", ".join(["id string", *[f"option_{i} string" for i in range(1, 6)]])
    rows = [("a", "CT  값", "ct 값", "x", None, ""), ("a", "CT  값", "ct 값", "x", None, ""), ("b", "1", "2", "3", "4", "5"), ("c", "y", "z", "y", " Y ", "z")]
    written(spark, tmp_path, "question_bank_candidate", rows, columns)
    got = {(r.id, r.option_key, r.places) for r in registry.queries()["duplicate_options"](spark, str(tmp_path)).collect()}
    assert got == {("a", "ct 값", 2), ("c", "y", 3), ("c", "z", 2)}


def test_chunks_mapped_to_several_scopes(spark, tmp_path):
    rows = [("1", "k1", "s1"), ("1", "k1", "s1"), ("2", "k1", "s2"), ("3", "k2", "s1"), ("4", "k2", "s1"), ("5", None, "s1"), ("6", "k2", ""), ("7", "k1", None)]
    written(spark, tmp_path, "question_bank_candidate_evidence", rows, "id string, rag_input_id string, mapped_scope_id string")
    got = {(r.rag_input_id, r.scopes) for r in registry.queries()["conflicting_scopes"](spark, str(tmp_path)).collect()}
    assert got == {("k1", 2)}
