import difflib
import hashlib

from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions import values as V


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_excerpt_and_keys(spark):
    assert one(spark, "  a \n b  ", lambda c: X.excerpt(c, 10)) == "a b"
    assert one(spark, "abc def", lambda c: X.excerpt(c, 4)) == "abc..."
    assert one(spark, "1. 방사선(기기) X", lambda c: X.compact_key(X.without_numbering(c))) == "방사선기기x"
    assert one(spark, None, X.compact_key) is None


def test_clean_lines_keeps_digits(spark):
    assert one(spark, " 37주\t 동안\n\n  12 x ", X.clean_lines) == "37주 동안\n12 x"


def test_sliding_chunks_closed_form(spark):
    for size in (0, 1, 1400, 1401, 2620, 2621, 4000):
        pieces = one(spark, "x" * size, X.sliding_chunks)
        expected = 0 if size == 0 else 1 if size <= 1400 else 1 + -(-(size - 1400) // 1220)
        assert len(pieces) == expected
        assert size == 0 or sum(len(p) for p in pieces) - 180 * (len(pieces) - 1) == size


def test_tokens_and_sentences(spark):
    assert one(spark, "CT 12 방사선a x", X.tokens) == ["ct", "방사선a"]
    assert one(spark, "가나. 다라? 마;바 3.5 사", X.sentences) == ["가나.", "다라?", "마", "바 3.5 사"]
    assert one(spark, "방사선은", X.suffix_free) == "방사선"


def test_sequence_ratio_is_the_library_one(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x"), ("", "")], "a string, b string")
    got = [r.r for r in rows.select(X.sequence_ratio("a", "b").alias("r")).collect()]
    assert got[:2] == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio()]
    assert got[2] is None or got[2] != got[2]
    assert got[3] == 1.0


def test_segments_hold_their_limits():
    text = " ".join(f"문장 번호 {i} 입니다 그리고 조금 더 깁니다." for i in range(60))
    parts = X.packed_sentences(text, 120, 420)
    assert " ".join(parts) == text and all(len(p) <= 420 for p in parts)
    assert X.packed_sentences("", 120, 420) == []


def test_ids_and_hashes(spark):
    assert one(spark, "a", lambda c: V.stable_id(c, F.lit(None))) == hashlib.sha256(b"a::").hexdigest()[:16]
    assert one(spark, "abc", lambda c: V.hash_modulo(c, 5)) == int(hashlib.sha256(b"abc").hexdigest()[:16], 16) % 5
    assert one(spark, "C", V.answer_number) == 3
    assert one(spark, "7", V.answer_number) is None
    assert one(spark, "x", lambda c: V.int_or(c, 4)) == 4
    assert one(spark, "Yes", V.truthy) is True
    assert one(spark, '["a", "b"]', V.string_list) == ["a", "b"]
    assert one(spark, "no list", V.string_list) == []
    assert one(spark, 'so: ```json\n{"a": {"b": 1}}\n```', V.json_from_text) == '{"a": {"b": 1}}'


def test_shuffle_can_be_undone():
    order = V.shuffled("session-1|q1", 5)
    assert sorted(order) == [0, 1, 2, 3, 4] and order == V.shuffled("session-1|q1", 5)


def test_similarity_pairs_are_all_pairs(spark, tmp_path):
    from granary.plans import texts

    lifted = "선량은 거리의 제곱에 반비례한다"
    long = "가나다라마바사 " * 40
    explanations = {"q1": lifted + "!", "q2": "짧은 글", "q3": long, "q4": "전혀 다른 설명 " * 3}
    contents = {"k1": long + lifted + long, "k2": "서로 다른 긴 내용이다. " * 40, "k3": "짧은 글과 말"}
    spark.createDataFrame(list(explanations.items()) + [("q5", None)], "id string, explanation string").write.parquet(f"{tmp_path}/question_bank_candidate.parquet")
    spark.createDataFrame(list(contents.items()), "rag_input_id string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(q, k) for q in [*explanations, "q5"] for k in contents] * 2, "candidate_id string, rag_input_id string").write.parquet(f"{tmp_path}/question_bank_candidate_evidence.parquet")
    got = {(r.candidate_id, r.rag_input_id): r.ratio for r in texts.similarity_pairs(spark, str(tmp_path)).collect()}
    want = {(q, k): round(difflib.SequenceMatcher(None, a.strip(), b.strip()).ratio(), 6) for q, a in explanations.items() for k, b in contents.items()}
    want["q1", "k1"] = want["q3", "k1"] = 1.0
    assert got == want


def test_numbering_and_words(spark):
    for raw, want in (("1. 총론", "총론"), ("1.2 총론", "총론"), ("iv. 총론", "총론"), ("#1 총론", "총론"), ("1) 총론", "총론"), ("(3) 총론", "총론"), ("No. 1 총론", "총론"), ("CT 총론", "CT 총론"), ("3상 전원", "3상 전원")):
        assert one(spark, raw, X.without_numbering) == want
    assert one(spark, "병원으로부터 차폐를 가 12를 CT에서", X.word_set) == ["병원", "차폐", "ct"]
    assert one(spark, "선량, 차폐 a  선량", X.boost_terms) == ["선량", "차폐"] and one(spark, None, X.boost_terms) == []


def test_segments_pack_to_the_limit():
    assert X.packed_sentences("가나다라. 마바사아. 자차카타.", 5, 12) == ["가나다라. 마바사아.", "자차카타."]
    assert X.packed_sentences("짧다. " + "긴" * 25 + ".", 5, 10) == ["짧다.", "긴" * 10, "긴" * 10, "긴" * 5 + "."]
    assert X.packed_sentences("가. 나.", 10, 20) == [] and X.packed_sentences("", 1, 5) == [] and X.packed_sentences("가" * 3 + " " + "나" * 3, 5, 6) == ["가가가 나나"]


def test_paragraphs_are_packed():
    text = "가" * 30 + "\n\n" + "나" * 30 + "\n \n" + "다" * 250 + "\n\n" + "라" * 10
    pieces = X.paragraph_pieces(text, 100, 20)
    assert pieces[0] == "가" * 30 + "\n\n" + "나" * 30 and pieces[1:5] == ["다" * 100, "다" * 100, "다" * 90, "라" * 10]
    assert X.paragraph_pieces("", 100, 20) == [] and X.paragraph_pieces("가" * 60 + "\n\n" + "나" * 60, 100, 20) == ["가" * 60, "가" * 20 + "\n\n" + "나" * 60]


def test_window_similarity():
    source = "x" * 200 + "격자비가 커지면 산란선 제거율이 높아진다." + "y" * 200
    best = max(difflib.SequenceMatcher(None, "격자비가 커지면 산란선 제거율이 높아진다.", source[i : i + 80]).ratio() for i in range(0, len(source) - 40, 80))
    assert X.window_similarity("격자비가 커지면 산란선 제거율이 높아진다.", source) == best > 0.3
    assert X.window_similarity("짧다.", source) == 0.0 and X.window_similarity("", "") == 0.0


def test_shown_text(spark):
    page = "<html><style>p{}</style><p>가 &amp; 나<br>다</p><script>x()</script><ul><li>라&nbsp;마</li></ul><!-- no --></html>"
    assert one(spark, page, X.html_to_text) == "가 & 나\n다\n라 마"
    assert one(spark, '<a href="x">', X.html_escaped) == "&lt;a href=&quot;x&quot;&gt;"
    assert one(spark, "one two three " + "x" * 30, lambda c: X.wrapped(c, 9, 3)) == ["one two", "three", "x" * 9]
    assert one(spark, "(가) (B) 설명 (A)", X.level_marker) == "B" and one(spark, "(가) (B) 설명 (A)", X.without_level_marker) == "(가) 설명 (A)"
    assert one(spark, "a/b c?.pdf", X.slug) == "a_b_c_.pdf" and one(spark, "12 kV 3mAs 4", X.numbers_with_units) == ["12kV", "3mAs", "4"]


def test_model_values(spark):
    options = F.array(*[F.lit(str(i)) for i in range(5)])
    for raw, want in (("3", 1), ("9", 0), ("0", 0), ("[1, 2]", 2), ('{"a": 1}', 1), ('"1, 2,"', 2), ('"A"', 1), ("", 0), ("null", 0), (None, 0)):
        assert one(spark, raw, lambda c: V.answer_count(c, options)) == want
    for raw, want in (('["a", "b"]', ["a", "b"]), ('{"2": "b", "1": "a"}', ["a", "b"]), ('[{"text": "a"}, {"content": "b"}]', ["a", "b"]), ("x", []), (None, [])):
        assert one(spark, raw, V.option_list) == want
    fixed = one(spark, '{"overall_verdict": "ok", "checks": {"a": {"verdict": "pass", "reason": ""}}}', lambda c: V.normalized_verdict(c, ("pass", "revise"), ("a", "b"), "revise", "missing", "none given"))
    assert fixed.verdict == "revise" and fixed.revision_required and fixed.checks["a"].reason == "none given" and fixed.checks["b"].verdict == "revise"
    assert fixed.errors == ["invalid overall_verdict: ok", "missing check reason: a", "missing check: b", "notes is missing or not a string"]
    moved = spark.createDataFrame([(["a", "b", "c"], 1, 3, "s"), (["a"], 2, 1, "s"), (None, 1, 1, "s")], "o array<string>, a int, t int, s string").select(V.relocated("o", "a", "t", "s").alias("m")).collect()
    assert moved[0].m[2] == "a" and sorted(moved[0].m) == ["a", "b", "c"] and moved[1].m == ["a"] and moved[2].m is None
