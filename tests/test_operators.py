import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import gates, retrieval, sequences, store
from granary.sources import jsonl
from granary.streaming import incremental


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reasons_treat_null_as_not_held(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("c", 5)], "id string, n int")
    checks = [("small", F.col("n") < 3), ("odd", F.col("n") % 2 == 1)]
    got = df.select("id", gates.first_reason(checks, "ok").alias("r"), gates.all_reasons(checks).alias("all"))
    assert rows_of(got, "id", "r") == [("a", "ok"), ("b", "small"), ("c", "odd")]
    assert rows_of(got, "id", "all")[1] == ("b", ["odd", "small"])


def test_quality_bands(spark):
    df = spark.createDataFrame([(600, None), (600, 50.0), (600, 40.0), (120, None), (119, 90.0)], "n int, c double")
    assert [r.q for r in df.select(gates.quality_band(F.col("n"), F.col("c")).alias("q")).collect()] == ["high", "medium", "low", "medium", "low"]


def test_bm25_against_the_formula(spark):
    docs = [(1, "aa bb bb", "cc"), (2, "bb", "aa"), (3, "dd", ""), (4, None, "ee aa"), (5, "", "")]
    df = spark.createDataFrame(docs, "id int, content string, scope string")
    queries = spark.createDataFrame([("q", "aa"), ("q", "bb"), ("q", "bb")], "query string, term string")
    got = {r.id: r.score for r in retrieval.bm25(df, "id", {"content": 0.35, "scope": 1.0}, queries).collect()}
    bags = {i: Counter({}) for i, _, _ in docs}
    length = {}
    for i, c, s in docs:
        for field, w in (((c or "").split(), 0.35), ((s or "").split(), 1.0)):
            for t in field:
                bags[i][t] += w
        length[i] = len((c or "").split()) + len((s or "").split())
    mean = sum(length.values()) / len(docs)
    for i in got:
        want = 0
        for t in ("aa", "bb"):
            n = sum(1 for b in bags.values() if b[t])
            idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
            f = bags[i][t]
            want -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean)) if f else 0
        assert got[i] == pytest.approx(want)
    assert set(got) == {1, 2, 4}


def test_nearest_ties_by_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<float>")
    got = retrieval.nearest(df, df.filter("id = 0"), "id", "v", 2)
    assert rows_of(got, "rank", "id") == [(1, 1), (2, 2)]


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "z"), ("b", 4, None)], "k string, n int, v string")
    filled = sequences.filled_forward(df, "v", ["k"], ["n"], "f")
    assert sorted((r.n, r.f or "") for r in filled.collect()) == [(1, "x"), (2, "x"), (3, "z"), (4, "")]
    pairs = sequences.consecutive_pairs(df, ["k"], [F.asc("n")], ["n"])
    assert rows_of(pairs, "k", "n_1", "n_2") == [("a", 1, 2)]
    quotas = spark.createDataFrame([("a", 1), ("a", 1), ("c", 3)], "k string, need int")
    assert rows_of(sequences.fill_quota(df, quotas, ["k"], "need", [F.desc("n")]), "n") == [(2,), (3,)]
    assert rows_of(sequences.fanned_out(quotas, F.col("need") - 1), "k", "variant") == [("c", 0), ("c", 1)]
    assert rows_of(sequences.first_per_key(df, ["k"], [F.desc("n")]), "n") == [(3,), (4,)]


def test_a_key_over_many_ranges_is_filled_numbered_and_paired(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, str(i) if i % 11 == 0 else None) for i in range(3_000)] + [(None, 5_000, "n"), (None, 5_001, None)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    before, after, last, number = {}, {}, {}, {}
    for key in {k for k, _, _ in rows}:
        own = [(n, v) for k, n, v in rows if k == key]
        value = None
        for place, (n, v) in enumerate(own):
            value = v or value
            last[n], number[n] = value, place + 1
            before[n], after[n] = own[place - 1][0] if place else None, own[place + 1][0] if place + 1 < len(own) else None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r.n: r.f for r in sequences.filled_forward(df, "v", ["k"], ["n"], "f").collect()} == last
        assert {r.n: r.p for r in sequences.numbered_within(df, ["k"], [F.asc("n")], "p").collect()} == number
        beside = sequences.neighbours(df, ["k"], [F.asc("n")], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.n: r.before for r in beside} == before and {r.n: r.after for r in beside} == after


def test_upsert_keeps_and_adds(spark):
    old = spark.createDataFrame([("1", "passed", "t1"), ("2", None, "t2")], "id string, status string, text string")
    new = spark.createDataFrame([("2", "fresh", "n2"), ("3", "fresh", "n3")], "id string, status string, text string")
    got = store.upserted(old, new, "id", ["status"])
    assert sorted((r.id, r.status or "", r.text) for r in got.collect()) == [("1", "passed", "t1"), ("2", "", "n2"), ("3", "fresh", "n3")]


def test_paging_is_clamped(spark):
    df = spark.range(30)
    assert [r.id for r in store.page_of(df, [F.asc("id")], 0, 1).collect()] == [0, 1, 2, 3, 4]
    assert store.page_of(df, [F.asc("id")], 2, 500).count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": broken\n[1]\n{"id": "2"}\n')
    schema = "id string, n int"
    kind = spark.createDataFrame([], schema).schema
    got = jsonl.read_tolerant(spark, str(tmp_path / "a.jsonl"), kind)
    good = got.filter("parse_error is null").filter("id is not null")
    assert rows_of(good, "id") == [("1",), ("2",)]
    assert any(r.parse_error for r in got.collect())
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "a.jsonl"), kind).collect()
    assert jsonl.read_if_there(spark, str(tmp_path / "none.jsonl"), kind).count() == 0
    a = spark.createDataFrame([("1", 1)], schema)
    b = spark.createDataFrame([("1", 9), ("2", 2)], schema)
    assert rows_of(jsonl.union_first_wins([a, b], "id"), "id", "n") == [("1", 1), ("2", 2)]
    jsonl.write_csv(spark.createDataFrame([("1", None)], schema), str(tmp_path / "csv"), ["n", "id"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["n", "id"]


def test_files_are_listed_without_hidden_ones(spark, tmp_path):
    for name in ("a.txt", "README.md", "b.md"):
        (tmp_path / name).write_text("x")
    got = jsonl.read_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.select("path").collect()) == ["a.txt", "b.md"]


def test_incremental_append_takes_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(3).write.parquet(source)
    schema = spark.range(1).schema
    incremental.append_files(spark, source, schema, sink, state)
    spark.range(3, 5).write.mode("append").parquet(source)
    incremental.append_files(spark, source, schema, sink, state)
    assert rows_of(spark.read.parquet(sink), "id") == [(0,), (1,), (2,), (3,), (4,)]
    done = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert incremental.still_to_do(spark.range(3), done, ["id"]).count() == 2


def test_windowed_counts(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'a'")
    assert [r.n for r in incremental.windowed_counts(rows, "ts", "k").orderBy("start").collect()] == [2, 1]
