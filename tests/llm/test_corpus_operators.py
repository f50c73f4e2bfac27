import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import leakage, links, near_duplicates, packing, shared_spans, subjects

WORDS = [f"말{i}" for i in range(400)]


def edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = rng.choice(WORDS)
    rng.shuffle(out)
    return out


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    shared = sum((x & y).values())
    return shared / (len(a) + len(b) - shared)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    records = {}
    for g in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.randint(40, 90))]
        for k in range(4):
            records[f"{g:02d}{k}"] = edited(rng, base, 0.08 * k)
    records["copy1"], records["copy2"], records["short"] = records["000"], records["000"][::-1], ["말1"] * 5
    rows = [(i, " ".join(w[:10]), None, " ".join(w[10:]), "x") for i, w in records.items()]
    df = spark.createDataFrame(rows + rows[:2] + [("null", None, None, None, None)], "id string, stem string, option_1 string, explanation string, representative string")
    members, pairs = near_duplicates.near_duplicates(df, "id", ["stem", "option_1", "explanation"])
    got = {(r.id_a, r.id_b) for r in near_duplicates.expanded_links(members, pairs).collect()}
    ids = sorted(i for i in records if len(records[i]) >= 40)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similarity(records[a], records[b]) >= 0.7 - 1e-9}
    assert got == want and len(want) > 40
    assert {r.representative for r in members.filter("id in ('000', 'copy1', 'copy2')").collect()} == {"000"}
    none, _ = near_duplicates.near_duplicates(df.limit(0), "id", ["stem"])
    assert none.count() == 0


def test_a_class_of_many_copies_grows_with_its_copies(spark):
    text = " ".join(WORDS[:50])
    df = spark.createDataFrame([(f"{i:03d}", text) for i in range(60)] + [("x", text + " 말399")], "id string, t string")
    members, pairs = near_duplicates.near_duplicates(df, "id", ["t"])
    assert members.select("class").distinct().count() == 2 and pairs.count() == 1
    assert near_duplicates.expanded_links(members, pairs).count() <= 2 * 16 * 61


@pytest.mark.parametrize("options", [{}, {"part": 7}])
def test_large_linked_classes_come_out_in_full(spark, options):
    rng = random.Random(5)
    words, more = WORDS[:50], [*WORDS[:50], "말399"]
    texts = {f"a{i:02d}": rng.sample(words, 50) for i in range(40)} | {f"b{i:02d}": rng.sample(more, 51) for i in range(20)} | {f"c{i:02d}": more for i in range(20)}
    texts |= {f"d{i:02d}": WORDS[200:250] for i in range(20)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id string, t string")
    members, pairs = near_duplicates.near_duplicates(df, "id", ["t"])
    got = [(r.id_a, r.id_b) for r in near_duplicates.expanded_links(members, pairs, **options).collect()]
    ids = sorted(texts)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similarity(texts[a], texts[b]) >= 0.7}
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 80 * 79 // 2 + 20 * 19 // 2


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.id: r.group for r in links.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and got["y"] == "x" and "z" not in got


def test_difference_cover_has_every_difference():
    for period in (13, 73, 133):
        cover = shared_spans.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(shared_spans.difference_cover(133)) <= 20


def test_shared_spans_against_all_windows(spark):
    rng = random.Random(9)
    letters = "가나다라마바사아자차카타파하 "

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage = [noise(200), noise(260), noise(199)]
    texts = [("t", str(i), "f", noise(rng.randint(0, 300)) + passage[i % 3] + noise(rng.randint(0, 300))) for i in range(12)]
    alone = noise(220)
    texts += [("t", "own", "f", alone + noise(50) + alone), ("t", "null", "f", None), ("t", "empty", "f", ""), ("u", "0", "f", passage[0]), ("t", "long", "f", noise(30_000) + passage[1])]
    df = spark.createDataFrame([(*t, 1) for t in texts + texts[:3]], "table_name string, record_id string, field string, text string, start int")
    got = {(r.table_name, r.record_id, r.start, r.stop) for r in shared_spans.shared_spans(df, ["table_name", "record_id", "field"], ["table_name", "record_id"], "text").collect()}
    owners = {}
    for table, record, _, text in texts:
        for i in range(len(text or "") - 199):
            owners.setdefault(text[i : i + 200], set()).add((table, record))
    want = set()
    for table, record, _, text in texts:
        at = [i for i in range(len(text or "") - 199) if len(owners[text[i : i + 200]]) > 1]
        while at:
            first = last = at.pop(0)
            while at and at[0] <= last + 200:
                last = at.pop(0)
            want.add((table, record, first, last + 200))
    assert got == want and len(want) >= 9
    assert shared_spans.shared_spans(df.limit(0), ["record_id"], ["record_id"], "text").count() == 0


def test_windows_beyond_the_filter_size(spark):
    rng = random.Random(12)
    passage = ["".join(rng.choice("가나다라마바사 ") for _ in range(n)) for n in (200, 330, 260)]
    texts = [(i, i // 2, "".join(rng.choice("아자차카타파하 ") for _ in range(rng.randint(0, 400))) + passage[i % 3] + "끝" * (i % 5)) for i in range(20)]
    rows = spark.createDataFrame(texts, "row long, record long, text string")
    within, beyond = (sorted(map(tuple, shared_spans.shared_windows(rows, 200, most_bits=n).collect())) for n in (29, 6))
    assert within == beyond and len(within) >= 20


def test_filters_pass_few_others(spark):
    held = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5_000)], "hash long")
    found = shared_spans.filter_of(held, 29)
    assert found.marked(np.array([r.hash for r in held.collect()], np.int64).view(np.uint64)).all()
    assert found.marked(np.random.default_rng(2).integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.002
    assert shared_spans.filter_of(held, 10) is None


def test_shares_and_passages_of_records(spark):
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("가나다라마바사아자차카타파하 ") for _ in range(n))

    one, two = noise(240), noise(200)
    texts = [("c", "1", "stem", noise(60)), ("c", "1", "explanation", noise(100) + one + noise(40) + two), ("c", "2", "stem", None), ("c", "2", "explanation", one), ("k", "1", "content", two + noise(199))]
    texts += [("k", "2", "content", noise(300)), ("k", "3", "content", None), ("k", "4", "content", one[:-41])]
    df = spark.createDataFrame(texts + texts[:5], "table_name string, record_id string, field_name string, text string")
    keys, record = ["table_name", "record_id", "field_name"], ["table_name", "record_id"]
    got = [(r.table_name + r.record_id, r.characters, r.covered, r.share) for r in shared_spans.covered_shares(df, keys, record, "text").collect()]
    assert sorted(got) == [("c1", 640, 440, 440 / 640), ("c2", 240, 240, 1.0), ("k1", 399, 200, 200 / 399), ("k2", 300, 0, 0.0), ("k3", 0, 0, 0.0), ("k4", 199, 0, 0.0)]
    spans = [(r.table_name + r.record_id, r.start, r.stop, r.passage) for r in shared_spans.shared_spans(df, keys, record, "text", passage_column="passage").collect()]
    assert sorted(spans) == [("c1", 100, 340, one), ("c1", 380, 580, two), ("c2", 0, 240, one), ("k1", 0, 200, two)]
    assert shared_spans.covered_shares(df.limit(0), keys, record, "text").count() == 0


def test_passage_queries_hold_shares_and_passages(spark, tmp_path):
    from granary.llm import queries

    passage = "".join(chr(0xAC00 + i) for i in range(210))
    spark.createDataFrame([("q", "짧은 물음", passage + "끝", 1), ("r", "물음", None, 1)], "id string, stem string, explanation string, answer int").write.parquet(f"{tmp_path}/question_bank_candidate.parquet")
    spark.createDataFrame([("k", "앞 " + passage)], "rag_input_id string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    found = queries.queries()
    assert {(r.record_id, r.field_name, r.start, r.stop, r.passage) for r in found["p7_spans"](spark, str(tmp_path)).collect()} == {("q", "explanation", 0, 210, passage), ("k", "content", 2, 212, passage)}
    assert {(r.record_id, round(r.share, 6)) for r in found["p7_shares"](spark, str(tmp_path)).collect()} == {("q", round(210 / 216, 6)), ("r", 0.0), ("k", round(210 / 212, 6))}
    assert {r.record_id for r in found["p7_found"](spark, str(tmp_path)).collect()} == {"q", "k"}


def test_leaks_against_all_runs(spark):
    rng = random.Random(4)
    letters = "가나다라마바사아자차카타파하abcdefg0123456789"

    def text(n):
        return "".join(rng.choice(letters) + (" " if rng.random() < 0.2 else "") for _ in range(n))

    items = [(f"E{i}", text(rng.randint(90, 300))) for i in range(12)] + [("null", None), ("E0", None)]
    held = [t for _, t in items[:12]]
    documents = [(i, text(rng.randint(0, 400)) + (held[i % 12][: rng.randint(60, 400)].upper().replace(" ", ", ") if i % 2 else "") + text(50)) for i in range(80)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in documents + documents[:3]], "doc_id long, text string, item string")
    reference = spark.createDataFrame(items, "item_id string, item_text string")
    got = {(r.id, r.item, r.run) for r in leakage.leaked_items(df, "doc_id", "text", reference, "item_id", "item_text").collect() if r.run >= 100}
    want = set()
    for i, t in documents:
        flat = leakage.squeezed(t or "")
        for name, item in items[:12]:
            own = leakage.squeezed(item)
            best = 0
            for k in range(len(own) - 99):
                while k + best < len(own) + 0 and own[k : k + max(best + 1, 100)] in flat and k + max(best + 1, 100) <= len(own):
                    best = max(best + 1, 100)
            if best >= 100:
                want.add((i, name, best))
    assert got == want and len(want) > 10
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", reference, "item_id", "item_text").count() == 0
    assert leakage.leaked_items(df, "doc_id", "text", reference.limit(0), "item_id", "item_text").count() == 0


def test_plan_places_every_piece_within_the_capacity():
    rng = np.random.default_rng(1)
    for capacity, sizes in ((100, rng.integers(1, 101, 5000)), (2048, rng.integers(1, 900, 3000)), (50, np.full(999, 26)), (50, np.full(999, 1)), (10, np.array([], int))):
        counts = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
        plan = packing.Plan(counts, capacity)
        load = Counter()
        placed = Counter()
        for length, rank, first, each in plan.segments:
            end = min((r for n, r, _, _ in plan.segments if n == length and r > rank), default=counts[length])
            for r in range(rank, end):
                load[first + (r - rank) // each] += length
                placed[length] += 1
        assert placed == Counter(counts) and all(v <= capacity for v in load.values())
        least = -(-int(np.sum(sizes)) // capacity)
        large = int(np.sum(sizes > capacity / 2))
        assert len(load) <= max(least * 1.1 + 2, large * 1.02 + 2)


def test_packed_documents(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "짧은 글"), (2, ""), (3, None), (4, "긴 글 " * 400), (5, "a b c"), (5, "a b c")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, container int")
    got = packing.packed(df, "doc_id", "text", capacity=64).collect()
    assert {r.id for r in got} == {1, 4, 5} and max(Counter((r.container) for r in got).values()) >= 1
    load = Counter()
    for r in got:
        load[r.container] += r.tokens
    assert max(load.values()) <= 64
    assert sorted(r.first_token for r in got if r.id == 4) == [64 * i for i in range(sum(r.id == 4 for r in got))]
    assert sum(r.id == 5 for r in got) == 2
    assert packing.packed(df.limit(0), "doc_id", "text", capacity=64).count() == 0


def test_plans_hold_every_piece_and_come_near_the_lower_bound():
    rng = random.Random(8)
    for lengths in ([rng.randint(1, 100) for _ in range(4_000)], [34] * 900 + [33] * 600 + [67] * 500, [100] * 5, [51] * 7, [], [1]):
        counts = Counter(lengths)
        plan = packing.Plan(dict(counts), 100)
        load, placed = Counter(), Counter()
        for length, rank, first, each in plan.segments:
            after = [r for n, r, *_ in plan.segments if n == length and r > rank]
            many = min([counts[length], *after]) - rank
            placed[length] += many
            for i in range(many):
                load[first + i // each] += length
        assert placed == counts and (not load or max(load.values()) <= 100 and max(load) < plan.containers)
        assert plan.containers <= 1.05 * -(-sum(lengths) // 100) or lengths[:1] in ([51], [34])
    assert packing.Plan({34: 900, 33: 600, 67: 500}, 100).containers <= 990


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(2)
    own = {a: [f"{a}용어{chr(0xAC00 + 28 * i)}" for i in range(20)] for a in ("가", "나", "다")}
    shared = ["측정한다", "확인한다", "기록하고", "표준", "장비"]

    def sentence(area):
        return " ".join(rng.sample(own[area], 3) + rng.sample(shared, 2)) + "."

    documents, truth = [], {}
    for i in range(300):
        areas = rng.sample(sorted(own), rng.choice([1, 1, 2]))
        documents.append((i, " ".join(sentence(a) for a in areas for _ in range(4)), "x"))
        truth[i] = set(areas)
    for i in range(300, 340):
        documents.append((i, "식당 안내는 게시판 양식으로 접수합니다. 주차 구역은 공사로 쓸 수 없습니다.", "x"))
        truth[i] = set()
    documents += [(900, None, "x"), (901, "", "x")] + documents[:2]
    df = spark.createDataFrame(documents, "doc_id long, text string, share string")
    areas = spark.createDataFrame([(a, ", ".join(t[:4])) for a, t in own.items()], "code string, description string")
    labels = spark.createDataFrame([(i, a) for i in range(0, 300, 10) for a in truth[i]] + [(5000, "가"), (1, "none")], "doc_id long, code string")
    got = subjects.subject_mixtures(df, "doc_id", "text", areas, "code", "description", labels, "doc_id", "code").filter("share >= 0.25").collect()
    found = {i: {r.area for r in got if r.id == i} for i in truth}
    held = [i for i in truth if i % 10]
    assert sum(found[i] == truth[i] for i in held) >= 0.97 * len(held)
    assert subjects.subject_mixtures(df.limit(0), "doc_id", "text", areas, "code", "description", labels, "doc_id", "code").count() == 0
    assert subjects.subject_mixtures(df, "doc_id", "text", areas.limit(0), "code", "description", labels, "doc_id", "code").count() == 0


def test_leaks_with_small_edits_are_kept(spark):
    rng = random.Random(21)
    item, other = ("".join(chr(0xAC00 + rng.randrange(4_000)) for _ in range(n)) for n in (543, 900))
    edited = "".join("힣" if i % 60 == 30 else c for i, c in enumerate(item))
    df = spark.createDataFrame([(1, other[:300] + edited + other[300:]), (2, other), (3, other[:50] + item[100:250] + other[50:])], "doc_id long, text string")
    reference = spark.createDataFrame([("A", item)], "item_id string, item_text string")
    got = {r.id: r for r in leakage.leaked_items(df, "doc_id", "text", reference, "item_id", "item_text").collect()}
    assert set(got) == {1, 3} and got[1].run == 59 and got[1].share > 0.1
    assert got[3].run == 150 and 68 / 543 <= got[3].share <= 150 / 543


def test_python_functions_are_planned_once(spark, tmp_path):
    import contextlib
    import io

    from pyspark.sql import functions as F

    from granary.llm import canonical_list

    def python_steps(df):
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            df.explain()
        return shown.getvalue().count("ArrowEvalPython")

    df = spark.createDataFrame([("a", "x y")], "id string, t string")
    made = df.select("id", near_duplicates.features_udf(1, 4, 2)("t").alias("f")).select("id", "f.*")
    assert python_steps(made.filter(F.col("class").isNotNull())) == 1
    assert python_steps(df.select("id", packing.token_count()("t").alias("size")).filter("size > 0")) == 1
    listed = spark.createDataFrame([("k", "x")], "k string, n string")
    assert python_steps(canonical_list.map_to_list(df, ["id"], "t", listed, "k", "n").filter("canonical_key is not null")) == 1


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_pairs_goes_through_the_driver(spark):
    rng = random.Random(5)
    rows = [(f"{i:02d}", " ".join(rng.sample(WORDS, 60))) for i in range(20)] + [(f"c{i:02d}", " ".join(WORDS[:50] + WORDS[100 : 100 + i % 3])) for i in range(12)]
    members, pairs = near_duplicates.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", ["t"])
    edges = pairs.selectExpr("id_b AS u", "id_a AS v")
    for df in (near_duplicates.expanded_links(members, pairs), members, links._star(edges, True), links._star(edges, False)):
        plan = executed_plan(df)
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_a_filter_in_several_pieces(spark):
    held = spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5_000)], "hash long")
    found = shared_spans.filter_of(held, 29, block_bits=12, piece_bits=14)
    assert [len(p.value) for p in found.pieces] == [1 << 8] * 8
    assert found.marked(np.array([r.hash for r in held.collect()], np.int64).view(np.uint64)).all()
    assert found.marked(np.random.default_rng(4).integers(0, 1 << 64, 100_000, dtype=np.uint64)).mean() < 0.002
    assert not shared_spans.filter_of(held.limit(0), 29, block_bits=12, piece_bits=14).marked(np.arange(9, dtype=np.uint64)).any()


@pytest.mark.parametrize("most_bits", [29, 6])
def test_no_hashes_of_windows_go_through_the_driver(spark, most_bits):
    texts = [(i, i, "".join(chr(0xAC00 + 7 * j + 1_000 * (i % 3)) for j in range(230))) for i in range(6)]
    found = shared_spans.shared_windows(spark.createDataFrame(texts, "row long, record long, text string"), 200, most_bits=most_bits)
    assert "Broadcast" not in (plan := executed_plan(found)) and "SortMergeJoin" in plan
    assert found.count() == 6 * 31
