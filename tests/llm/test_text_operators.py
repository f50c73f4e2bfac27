import random
import unicodedata

from granary.llm import canonical_list, lookalikes, pair_defects, scans, splitting
from granary.llm.queries import OPTIONS


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_look_alike_values_become_equal(spark):
    values = [
        ("a", "CT 값 방사선·기록"), ("b", "СT 값 방사선･기록"), ("c", unicodedata.normalize("NFD", "CT 값 방사선·기록")), ("d", "C​T 값 방­사선‧기록"), ("e", "ＣＴ　값 방사선ㆍ기록"),
        ("f", "ct 값 방사선·기록"), ("g", None), ("h", ""), ("i", "​"), ("j", "10⁻³ cm² ①"), ("k", "3 Å, 5 µm"), ("k", "3 Å, 5 µm"), ("l", "原理"), ("m", "理"),
    ]
    df = spark.createDataFrame([(i, v, "x") for i, v in values], "id string, v string, consistent string")
    got = lookalikes.consistent_forms(df, ["id"], "v")
    rows = sorted(((r.id, r.consistent, r.changed) for r in got.collect()), key=str)
    forms = {i: (f, c) for i, f, c in rows}
    assert len(rows) == len(values)
    assert {forms[i][0] for i in "abcde"} == {"CT 값 방사선·기록"}
    assert [forms[i][1] for i in "abcdefghijkm"] == [False, True, True, True, True, False, False, False, True, False, True, True]
    assert forms["f"][0] == "ct 값 방사선·기록" and forms["g"][0] is None and forms["i"][0] == "" and forms["k"][0] == "3 Å, 5 μm" and forms["m"][0] == "理"
    assert lookalikes.consistent_forms(df.limit(0), ["id"], "v").count() == 0


def test_split_covers_the_text_with_overlap(spark):
    rng = random.Random(5)
    texts = ["", "x" * 1400, "x" * 1401, "x" * 5000, "가나다. " * 900, "\n\n".join("문단 하나. 둘! 셋?" * 20 for _ in range(12)), " ".join("ab" * rng.randint(1, 30) for _ in range(900))]
    for text in texts:
        pieces = splitting.split_bounds(text, 1400, 180)
        assert "".join(text[fresh:stop] for _, fresh, stop in pieces) == text
        assert all(stop - start <= 1400 for start, _, stop in pieces)
        assert all(fresh - start == min(180, fresh) for start, fresh, _ in pieces)
        assert (len(pieces) > 1) == (len(text) > 1400)
    df = spark.createDataFrame([(str(i), t, 0 if i == 3 else i, i + 4, 7) for i, t in enumerate(texts)] + [("n", None, 1, 2, 7)], "id string, content string, page_start int, page_end int, piece int")
    got = splitting.split_oversized(df, "id", "content", "page_start", "page_end").collect()
    assert {r.id for r in got} == {str(i) for i, t in enumerate(texts) if len(t) > 1400}
    for r in got:
        i = int(r.id)
        low = i if i != 3 else 7
        assert len(r.content) <= 1400 and low <= r.page_start <= r.page_end <= i + 4 and r.token_estimate == len(r.content) // 3
    assert splitting.split_oversized(df.limit(0), "id", "content").count() == 0


def test_split_prefers_strong_boundaries():
    text = ("가나다라 마바사. " * 60).strip() + "\n\n" + ("아자차카 타파하. " * 60).strip()
    (_, _, first), *_ = splitting.split_bounds(text, 800, 100)
    assert text[:first].endswith("\n\n")


def test_defects(spark):
    stem = "초음파 탐촉자의 주파수를 높일 때 먼저 나타나는 변화로 옳은 것은?"
    sound = "주파수가 높아지면 파장이 짧아져 축방향 분해능이 좋아지고 투과 깊이는 얕아진다."
    cases = [
        ("ok", sound, 3, None), ("note", sound + " (근거: 3장 20쪽)", 1, None), ("nodot", sound[:-1], 1, None), ("answer", sound, 9, "empty"), ("null", None, 1, "empty"), ("blank", " \n", 1, "empty"),
        ("placeholder", "[해설] (작성 예정)", 1, "empty"), ("none", sound, None, "empty"), ("cut", sound[:20], 1, "truncated"), ("dots", sound[:20] + "...", 1, "truncated"), ("open", sound + " (근거: 3장", 1, "truncated"),
        ("refuse", "죄송하지만 이 문항의 해설은 도와드리기 어렵습니다.", 1, "refusal"), ("refuse en", "I'm sorry, but I can't help with that request.", 1, "refusal"),
        ("copy", "문제: " + stem, 1, "copy"), ("copy options", stem + " ① 분해능 ② 깊이", 1, "copy"), ("language", "The wavelength becomes shorter and the axial resolution improves.", 1, "language"),
    ]
    rows = [(n, stem, e, a, "분해능", "깊이", None, None, None, "x") for n, e, a, _ in cases]
    df = spark.createDataFrame(rows + rows[:1], "id string, stem string, explanation string, answer int, option_1 string, option_2 string, option_3 string, option_4 string, option_5 string, defect string")
    got = pair_defects.pair_defects(df, "id", "stem", "explanation", "answer", OPTIONS)
    assert {r.id: r.defect for r in got.collect()} == {n: d for n, _, _, d in cases if d}
    assert pair_defects.pair_defects(df.limit(0), "id", "stem", "explanation", "answer", OPTIONS).count() == 0


def test_typed_values_find_their_entry(spark):
    reference = spark.createDataFrame([("1", "치료 자세 확인", "u"), ("2", "촬영 자세와 중심선", "u"), ("3", "벽 필터의 원리", "u"), ("4", None, "u"), ("5", "벽 필터의 원리·특성", "u")], "key string, name string, value string")
    cases = [
        ("치료자세확인", "1"), ("제2절 치료 자세 확인 (RT)", "1"), ("치료 세자 확인", "1"), ("촬영 자세·중심선", "2"), ("촬영 자세 및 중심선 관련", "2"), ("벽 필터 원리", "3"), ("벽 필터의 원리·특성 - 재확인", "5"),
        ("안과 굴절", "unmatched"), ("???", "unmatched"), ("", None), ("  ", None), (None, None), ("치​료 자세 확인", "1"),
    ]
    df = spark.createDataFrame([(str(i), v, "x") for i, (v, _) in enumerate(cases)], "id string, typed string, canonical_key string")
    got = canonical_list.map_to_list(df, ["id"], "typed", reference, "key", "name")
    assert [r.canonical_key for r in sorted(got.collect(), key=lambda r: int(r.id))] == [k for _, k in cases]
    empty = canonical_list.map_to_list(df, ["id"], "typed", reference.limit(0), "key", "name")
    assert {r.canonical_key for r in empty.collect()} == {None, "unmatched"}
    try:
        canonical_list.map_to_list(df, ["id"], "typed", reference, "key", "name", max_entries=2)
        raise AssertionError("a list beyond its bound must raise")
    except ValueError:
        pass


def test_mentions_keep_to_word_bounds():
    mapper = canonical_list.CanonicalMapper([("a", "CT"), ("b", "CT 장치"), ("c", "자기공명"), ("d", "공명영상학")], 0.45)
    names = {v: [mapper.entries[i][0] for _, _, i in mapper.mentions(v)] for v in ("ACTION", "directory", "CT의 값", "SPECT CT장치와 자기공명영상학", "ＣＴ", "")}
    assert names == {"ACTION": [], "directory": [], "CT의 값": ["a"], "SPECT CT장치와 자기공명영상학": ["d", "b"], "ＣＴ": [], "": []}
    assert mapper.map("ＣＴ") == "a" and mapper.map("ACTION plan") == canonical_list.UNMATCHED


def test_look_alikes_of_unicode_data_become_equal(spark):
    values = ["A", "𝐀", "Ａ", "Ꭺ", "fi", "ﬁ", "mm", "㎜", "III", "Ⅲ", "a-b", "a‑b", "ab", "a\U000e0041b", "cm²", "①", "½", "ㄱ"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = {r.id: (r.consistent, r.changed) for r in lookalikes.consistent_forms(df, ["id"], "v").collect()}
    plain = ["A", "A", "A", "A", "fi", "fi", "mm", "mm", "III", "III", "a-b", "a-b", "ab", "ab", "cm²", "①", "½", "ㄱ"]
    assert [got[i][0] for i in range(len(values))] == plain and [got[i][1] for i in range(len(values))] == [v != p for v, p in zip(values, plain)]


def test_scan_traces_one_text_alone():
    sections = scans.section_pattern(["비전리 영상", "CT"])
    dirty = [
        "앞 문장이 이어지는 중에 선-\n량을 잰다.", "값은 1O.5 mGy이다.", "조건을 ¬ 따로 만족하였다.", "- 13 -\n조건을 따로 만족하였다.", "조건을 따로\np. 7\n만족하였다.",
        "측방 분해능 강의 노트   제1장  15\n조건을 따로 만족하였다.", "12  측방 분해능 비전리 영상\n조건을 만족하였다.", "값은 3.5 rnGy 정도다.", "빔을 추적 | 검사에 쓴다.",
    ]
    clean = ["8. 분할 일정의 원리\n조건을 따로 만족하였다.", "조건을 따로\n만족하였다.", "- 첫째 항목이다.\n- 둘째 항목이다.", "병렬 수신 5987 ms | 위상 부호화 95.4 ms | 반복 시간 3 ms", "", "Tc-99m·F-18 자료는 SpO2와 T1을 본다."]
    model = scans.learned(scan_sample("강의 노트"), sections)
    assert [scans.has_traces(t, sections, model) for t in dirty] == [True] * len(dirty)
    assert [scans.has_traces(t, sections, model) for t in clean] == [False] * len(clean)
    text = "측방 분해능 강의 노트   제1장  15\n조건을 따로 만족-\n하였다. 값은 1O.5 mGy이고 초건\n- 13 -\n이 다르다."
    assert scans.repaired(text, sections, model, {"초건": "조건"}, set()) == "조건을 따로 만족하였다. 값은 10.5 mGy이고 조건 이 다르다."


def scan_sample(title):
    """Texts of a few lines, every other one with a header of that title or a page number."""
    rng = random.Random(4)
    words = [chr(0xAC00 + 97 * i) + chr(0xB098 + 31 * i) for i in range(60)]

    def sentence():
        return " ".join(rng.sample(words, 5)) + rng.choice([" 만족하였다.", f" T{rng.randint(1, 9)}을 {rng.randint(1, 99)} ms 만큼 본다."])

    texts = []
    for i in range(400):
        lines = [sentence() if rng.random() < 0.6 else " ".join(rng.sample(words, 14)) for _ in range(rng.randint(2, 4))] + [sentence()]
        name = " ".join(rng.sample(words, 2))
        header = [f"{i % 90}  {name} {title} {i % 9}권", f"{name}   제{i % 9}장  {i % 90}", f"< {name} {title} {i % 9}권 >", f"{name}  비전리 영상", f"{i % 90}  {name}   CT"][i % 5]
        extra = [[], [header], [f"- {i % 90} -"], [], [f"{i % 9}. {name} 원리"], []][i % 6]
        texts.append("\n".join(extra + lines if i % 2 else lines[:1] + extra + lines[1:]))
    return texts


def test_titles_of_headers_are_learned():
    sections = scans.section_pattern(["비전리 영상", "CT"])
    rng = random.Random(5)
    for title in ("강의 노트", "가람 누리집", "Volume Book"):
        model = scans.learned(scan_sample(title), sections)
        texts = [f"새 {chr(0xAC00 + rng.randrange(9_000))} {title} {i % 9}권\n새 조건을 따로 만족하였다." for i in range(50)]
        assert sum(scans.has_traces(t, sections, model) for t in texts) >= 49
        assert not any(scans.has_traces(f"새 조건 {i}\n새 조건을 따로 만족하였다.", sections, model) for i in range(50))
    assert scans.learned([], sections).labels_of(["본문이다."], sections) == [scans.BODY]


def test_words_misread_in_many_places_are_found(spark):
    right = "정관영검점량율확절촬방정관영검"
    wrong = "".join({v: k for k, v in scans.SYLLABLES.items()}[c] for c in right)
    df = spark.createDataFrame([(str(i), f"{right} 나머지 {i}") for i in range(40)] + [("x", f"{wrong} 나머지"), ("y", "enamel rnore"), *[(f"m{i}", f"more {i}") for i in range(30)]], "id string, text string")
    assert {r.word: r.right for r in scans.Lexicon(df).misread.collect()} == {wrong: right, "rnore": "more"}


def test_scan_words_of_all_rows(spark):
    plain = "선량을 조정한다. 모니터 단위를 본다."
    rows = [(str(i), plain, "x") for i in range(60)] + [("misread", "선랑을 초징한다. 단위를 본다.", "x"), ("cut", "선량을 조정한다. 모니\n터 단위를 본다.", "x"), ("null", None, "x"), ("empty", "", "x")]
    df = spark.createDataFrame(rows + rows[-4:-3], "id string, text string, word string")
    assert found(scans.scanned_rows(df, ["id"], "text", []), "id") == [("cut",), ("misread",)]
    mended = {r.id: r.repaired for r in scans.repaired_texts(df, ["id"], "text", []).collect()}
    assert mended == {"misread": "선량을 조정한다. 단위를 본다.", "cut": plain}
    assert scans.scanned_rows(df.limit(0), ["id"], "text", []).count() == 0


def test_copies_of_a_scanned_text_do_not_outvote_the_right_words(spark):
    rows = [(f"plain{i}", f"선량을 조정한다. 모니터 단위 {i}번을 본다.") for i in range(60)]
    rows += [(f"misread{i:02d}", "선량을 초징한다. 단위를 본다.") for i in range(40)] + [("other", "다시 초징한다.")]
    rows += [(f"cut{i:02d}", "선량을 조정한다. 모니\n터 단위를 본다.") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, text string")
    want = [f"misread{i:02d}" for i in range(40)] + [f"cut{i:02d}" for i in range(40)] + ["other"]
    assert found(scans.scanned_rows(df, ["id"], "text", []), "id") == sorted((i,) for i in want)
    mended = {r.id: r.repaired for r in scans.repaired_texts(df, ["id"], "text", []).collect()}
    assert mended["misread07"] == "선량을 조정한다. 단위를 본다." and mended["cut07"] == "선량을 조정한다. 모니터 단위를 본다." and mended["other"] == "다시 조정한다."
