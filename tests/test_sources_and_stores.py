import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import index, store, where
from granary.operators import retrieval as R
from granary.operators import sequences as S
from granary.sources import jsonl

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def lines(path, *texts):
    path.write_text("\n".join(texts) + "\n", encoding="utf-8")
    return str(path)


def test_tolerant_lines_have_numbers(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", '{"id": "a", "n": 1}', "", "{broken", '{"id": "b", "n": 2}', "[1]")
    rows = sorted((r.line_number, r.id, r.n, r.parse_error) for r in jsonl.read_tolerant(spark, path, ROW).collect())
    assert rows == [(1, "a", 1, None), (3, None, None, "{broken"), (4, "b", 2, None), (5, None, None, "[1]")]


def test_numbers_hold_over_splits(spark, tmp_path):
    path = lines(tmp_path / "long.txt", *[f"line {i} " + "x" * 90 for i in range(3_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.numbered_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.line_number for r in rows) == list(range(1, 3_001)) and all(r.value.startswith(f"line {r.line_number - 1} ") for r in rows)


def test_strict_lines(spark, tmp_path):
    good = lines(tmp_path / "g.jsonl", '{"id": "a", "n": 1}', " ", '{"id": "b"}')
    assert sorted((r.id, r.n) for r in jsonl.read_strict(spark, good, ROW).collect()) == [("a", 1), ("b", None)]
    for text in ("{", "[]", '"x"'):
        with pytest.raises(PySparkException, match="broken line in .*bad.jsonl"):
            jsonl.read_strict(spark, lines(tmp_path / "bad.jsonl", text), ROW).collect()
    assert jsonl.read_if_there(spark, str(tmp_path / "none.jsonl"), ROW).count() == 0
    assert jsonl.read_if_there(spark, f"file://{good}", ROW).count() == 2


def test_documents_arrays_and_objects(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"rows": [{"id": "a", "n": 1}, {"id": "b"}], "n": {"deep": [{"id": "c"}]}}')
    (tmp_path / "list.json").write_text('[{"id": "z", "n": 9}]')
    assert [(r.pos, r.id) for r in jsonl.read_array(spark, str(tmp_path / "doc.json"), ROW).collect()] == [(0, "a"), (1, "b")]
    assert [(r.id, r.n) for r in jsonl.read_array(spark, str(tmp_path / "list.json"), ROW).collect()] == [("z", 9)]
    missing = jsonl.read_document(spark, str(tmp_path / "no.json"), ROW).collect()
    assert [(r.id, r.n) for r in missing] == [(None, None)]
    text = spark.createDataFrame([(1, (tmp_path / "doc.json").read_text()), (2, "{"), (3, None)], "k int, x string")
    got = {(r.k, r.path) for r in jsonl.objects_within(text, "x", ["k"]).collect()}
    assert got == {(1, "$"), (1, "$.rows[0]"), (1, "$.rows[1]"), (1, "$.n"), (1, "$.n.deep[0]")}


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_bytes("둘째\f셋째".encode() + b"\xff")
    (tmp_path / "a.txt").write_text("첫째", encoding="utf-8")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = sorted((r.suffix, r.record, r.text) for r in jsonl.read_texts(spark, str(tmp_path)).collect())
    assert got == [("md", 0, "둘째"), ("md", 1, "셋째"), ("txt", 0, "첫째")]
    assert [r.name for r in jsonl.listed_files(spark, str(tmp_path), ("txt", "md")).collect()] == ["a.txt", "b.md"]
    by = jsonl.dispatched(spark, str(tmp_path), {"txt": lambda f: f.select("path", F.lit("text").alias("kind")), "bin": lambda f: f.select("path", F.lit("bytes").alias("kind"), "length")})
    assert sorted((r.kind, r.length) for r in by.collect()) == [("bytes", 1), ("text", None)]


def test_unions_and_reports(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 1)], "id string, n int"), spark.createDataFrame([("x", 2), ("z", 2)], "id string, n int")
    first, again = jsonl.union_counted([a, b], "id")
    last, _ = jsonl.union_counted([a, b], "id", last=True)
    assert sorted((r.id, r.n) for r in first.collect()) == [("x", 1), ("y", 1), ("z", 2)] and [(r.id, r.duplicates) for r in again.collect()] == [("x", 1)]
    assert sorted((r.id, r.n) for r in last.collect()) == [("x", 2), ("y", 1), ("z", 2)]
    labelled = jsonl.union_labelled({"pass": a, "error": b.withColumn("why", F.lit("?"))}, "verdict")
    assert sorted((r.verdict, r.id, r.why) for r in labelled.collect()) == [("error", "x", "?"), ("error", "z", "?"), ("pass", "x", None), ("pass", "y", None)]
    assert json.loads(jsonl.json_report(a.orderBy("id"))) == [{"id": "x", "n": 1}, {"id": "y", "n": 1}]
    assert jsonl.markdown_report(a.orderBy("id"), "T").splitlines() == ["# T", "", "| id | n |", "| --- | --- |", "| x | 1 |", "| y | 1 |"]
    with pytest.raises(ValueError):
        jsonl.json_report(a, most=1)


def test_store_guards(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    assert store.inserted(rows, spark.createDataFrame([("c", 4), (None, 5)], "id string, n int"), "id").filter("id is not null").count() == 4
    for bad in ([("a", 9)], [("c", 1), ("c", 2)]):
        with pytest.raises(PySparkException, match="duplicate key"):
            store.inserted(rows, spark.createDataFrame(bad, "id string, n int"), "id").collect()
    with pytest.raises(ValueError):
        store.updated(rows, F.col("n") > 0, {"n": F.lit(0)}, most=2)
    assert sorted(r.n for r in store.updated(rows, F.col("id") == "a", {"n": F.lit(7)}).collect()) == [2, 3, 7]
    assert store.deleted(rows, {}).count() == 3 and store.deleted(rows, {"id": None}).count() == 2


def test_conditions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)], "id string, n int, t string")
    ids = lambda **w: sorted(r.id for r in where.selected(rows, **w).collect())
    assert ids(n=[1, 3]) == ["a", "c"] and ids(_n=2) == ["a", "c"] and ids(t=None) == ["c"] and ids(_t=None) == ["a", "b"] and ids(nothing=1) == ["a", "b", "c"]
    assert ids(n=[2, 3], between="n") == ["b", "c"] and ids(id="a", t="y", any_of="id,t") == ["a", "b"] and ids(n=lambda c: c > 1) == ["b", "c"] and ids(n=[]) == []
    assert where.selected(rows, fields="id,zz", order_by="n", descending=True, page=2, size=1).collect() == [("b",)]


def test_stored_indexes(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "방사선 선량 10", "선량"), ("k2", "초음파 영상", "영상"), ("k2", "초음파 영상", "영상"), ("k3", "선량 선량 한도", "")], "key string, content string, scope string")
    queries = spark.createDataFrame([("q", "선량"), ("q", "10"), ("r", "영상")], "query string, term string")
    path = str(tmp_path / "index")
    index.build_text_index(rows, path, "key", {"content": 0.35, "scope": 1.0}, buckets=4)
    with pytest.raises(PySparkException):
        index.build_text_index(rows, path, "key", {"content": 0.35, "scope": 1.0}, buckets=4)
    stored = spark.read.parquet(f"{path}/rows")
    assert sorted((r.doc_id, r.key) for r in stored.collect()) == [(1, "k1"), (2, "k2"), (3, "k3")]
    got = {(r.query, r.id): round(r.score, 9) for r in index.search_text_index(spark, path, queries, buckets=4).collect()}
    want = {(r.query, r.id): round(r.score, 9) for r in R.bm25(stored, "doc_id", {"content": 0.35, "scope": 1.0}, queries).collect()}
    assert got == want and set(got) == {("q", 1), ("q", 3), ("r", 2)}
    vectors = spark.createDataFrame([("b", [1.0]), (None, [2.0]), ("a", [3.0])], "id string, v array<float>")
    index.build_vector_index(vectors, str(tmp_path / "v"), "id", "v")
    assert sorted((r.embedding_index, r.row_id) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [(0, "a"), (1, "b"), (2, "embedding_row_00000002")]
    assert index.read_vector_index(spark, str(tmp_path / "none"), vectors.schema).count() == 0


def test_greedy_pairs_have_different_parents(spark):
    rows = [("g", f"r{i}", f"p{i % 3 if i > 4 else 0}", float(20 - i)) for i in range(12)] + [("h", "x", "p", 1.0)]
    got = S.distinct_pairs(spark.createDataFrame(rows, "g string, id string, parent string, score double"), "g", "id", "parent", "score", 3).collect()
    whole = S.greedy_pairs([(i, p, s) for g, i, p, s in rows if g == "g"], 3)
    assert sorted((r.first, r.second, r.score) for r in got) == sorted(whole) and len(whole) == 3
    parent = {i: p for _, i, p, _ in rows}
    assert all(parent[a] != parent[b] for a, b, _ in whole)


def test_numbers_over_the_whole_order(spark):
    rows = spark.range(1_000).select(((F.col("id") * 7) % 1_000).alias("k"), F.lit("x").alias("number_of"))
    assert [(r.k, r.number) for r in S.numbered(rows, [F.asc("k")]).orderBy("k").collect()] == [(i, i + 1) for i in range(1_000)]
