"""Problem 5: defective question and explanation pairs.

Method: ordered rules on built-in string functions; every triggered defect type is emitted, and the first in the order
of :data:`DEFECTS` is the type of the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "refusal", "language", "copy", "truncated")

# What stands in an explanation that was not written (compared without spaces, brackets and marks).
PLACEHOLDERS = (
    "na", "none", "null", "nil", "nan", "tbd", "todo", "tba", "pending", "blank", "empty", "xxx", "noexplanation", "notavailable",
    "미작성", "미정", "미기재", "없음", "해설없음", "설명없음", "해당없음", "작성예정", "추후작성", "추후입력", "추후기재", "입력예정",
    "해설준비중", "준비중", "작성중", "해설미작성", "내용없음", "해설예정", "해설추후입력", "해설작성예정",
)
# Phrases by which a text declines, in lower case.
REFUSALS = (
    r"(말씀|알려|설명|답변|도와|안내|제공|작성|풀이|해설|생성|응답|공개|드리|드릴|답)\S{0,6}\s?(지 못합니다|지 않겠습니다|지 않습니다|기 어렵습니다|기 곤란합니다|수 없습니다|수 없어요|수 없음을|수가 없습니다|지 못해|기는 어렵습니다)",
    r"(생성|응답|답변|작성|제공|해설|설명|공개)\S{0,2} (거부|거절|사양)(합니다|하겠습니다|할게요)",
    r"(응답|답변|제공|작성|설명|공개)\S{0,2} (제한됩니다|제한되어 있습니다|불가합니다|불가능합니다|금지되어 있습니다)",
    r"(저는|나는) (인공지능|ai|언어 모델|챗봇)",
    r"\bas an? (ai|artificial|language model|large language)",
    r"\b(i|we)\s?( am|'m|’m| are|'re|’re)? ?(sorry|unable|not able|afraid)\b",
    r"\b(i|we) (cannot|can't|can’t|can not|won't|won’t|will not|must decline|decline|refuse|have to decline|am not permitted|am not allowed|do not feel)\b",
    r"\b(unable|not able|not permitted|not allowed) to (help|assist|answer|write|provide|explain|comply|fulfil|fulfill|respond|discuss|share|generate|give)\b",
    r"\b(cannot|can't|can’t|can not|won't|won’t) (help|assist|answer|write|provide|explain|comply|fulfil|fulfill|respond|discuss|share|generate|give)\b",
    r"(申し訳|恐れ入り|すみません)|(お答え|回答|説明|お手伝い|提供|対応|作成|生成)(は|を|が)?\S{0,4}(できません|できかねます|いたしかねます|控えさせ|お断り|しかねます)",
    r"(抱歉|对不起|對不起|很遗憾|不好意思)|(无法|無法|不能|拒绝|不便)(为您|为你|對您)?(提供|回答|解释|回应|协助|帮助|完成|撰写|生成|说明|给出)|作为(一个|一名)?(人工智能|ai|语言模型)",
    r"\b(lo siento|no puedo|désolé|je ne peux|ne puis|es tut mir leid|kann ich nicht|ich kann nicht|não posso|desculpe|không thể|xin lỗi)\b",
)
REFUSAL = "|".join(f"(?:{p})" for p in REFUSALS)
# Every phrase above holds one of these: a cheap test before the long one.
MAY_REFUSE = (
    "니다", "없어요", "없음을", "못해", "할게요", "는 ai", "인공지능", "언어 모델", "챗봇", "sorry", "unable", "not ", "cannot", "can't", "can’t", "won't", "won’t", "afraid", "decline", "refuse", "as a ", "as an ",
    "lo siento", "puedo", "désolé", "peux", "puis", "leid", "kann", "posso", "desculpe", "không", "xin",
)
CLOSING = "\"'”’」』)]】 \t\n\r\x0b\f"
LEAD = r"^\s*(?:[\[(<【]?\s*(?:해설|정답\s?해설|풀이|설명|explanation|answer)\s*[\])>】]?\s*[:：]?\s*)+"
NOTE = r"\s*(?:[(\[](?:근거|출처|참고|참조)\s*[:：][^()\[\]]*[)\]]|\n\s*(?:※|\*|[-•])\s*(?:참고|근거|출처|주)\s*[:：][^\n]*)\s*$"
ASKED = r"(?:을|를)? 묻는 (?:문항|문제|질문)(?:이다|입니다|임)?\s*[.]?\s*$"
ANSWER_LINE = r"(?:따라서 |그러므로 )?정답은 ?[①-⑤1-5](?:번)?(?:이다|입니다|이며|임)?[.,]?"


def squeezed(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def is_empty(said: Column, flat: Column, answer: Column) -> Column:
    """``said`` is the squeezed explanation without its lead, ``flat`` with it."""
    return answer.isNull() | ~answer.between(1, 5) | (said == "") | said.isin(*PLACEHOLDERS) | flat.isin(*PLACEHOLDERS)


def is_refusal(lowered: Column) -> Column:
    may = lowered.rlike(r"[ぁ-ヿ一-鿿]")
    for word in MAY_REFUSE:
        may = F.contains(lowered, F.lit(word)) | may
    return may & lowered.rlike(REFUSAL)


def is_other_language(stem: Column, explanation: Column) -> Column:
    """The stem is Hangul, and of the explanation's letters hardly any are."""
    letters, hangul = count_of(explanation, r"\p{L}+"), count_of(explanation, r"[가-힣ᄀ-ᇿ]+")
    return (hangul < 0.2 * letters) & (letters >= 8) & (count_of(stem, r"[가-힣ᄀ-ᇿ]+") * 2 > count_of(stem, r"\p{L}+"))


def is_copy(flat: Column, of_stem: Column, body: Column, stem: Column, options: list[Column]) -> Column:
    """What remains without the stem, the options and the naming of the answer is next to nothing.

    Either the squeezed stem stands in the explanation (or the reverse) and the rest is in the options, or nearly all the
    explanation's words are words of the stem and the options. ``flat`` is the squeezed body; the options are looked at
    only where the stem is in it or shares half its words.
    """
    rest = F.replace(flat, of_stem, F.lit(""))
    for option in options:
        sought = squeezed(option)
        rest = F.replace(rest, F.when(F.length(sought) > 1, sought).otherwise(F.lit("\x00")), F.lit(""))
    holds = (F.length(of_stem) >= 10) & F.contains(flat, of_stem) & (F.length(rest) <= F.greatest(F.lit(8), 0.1 * F.length(flat)))
    inside = (F.length(flat) >= 12) & F.contains(of_stem, flat)
    own, asked = words(body), words(stem)
    same = (F.size(F.array_intersect(own, asked)) >= 0.5 * F.size(asked)) & (F.size(own) >= 5)
    same = F.when(same, F.size(F.array_except(own, words(F.concat_ws(" ", stem, *options)))) <= 0.15 * F.size(own)).otherwise(False)
    return (F.length(of_stem) > 0) & (holds | inside | same)


def is_truncated(text: Column) -> Column:
    """The last sentence does not end, or a bracket stays open; ``text`` is trimmed and without a note after it."""
    tail = F.substring(F.rtrim(text, F.lit(CLOSING)), -4, 4)
    ends = tail.rlike(r"(?:[^\d\s.…,][.。]|[!?！？。])$|(?:다|요|죠|까|[함음임됨])$") & ~tail.rlike(r"(?:\.\.|…)$")
    opened = F.when(F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")), F.length(F.translate(text, "([", "")) < F.length(F.translate(text, ")]", ""))).otherwise(False)
    return ~ends | opened


def pair_defects(df: DataFrame, id_column: str, stem: str, explanation: str, answer: str, options: list[str]) -> DataFrame:
    """id, defects (every triggered type, in order) and defect (the first) of each defective pair; sound pairs have no row.

    A null or empty explanation is ``empty``, whatever the stem; without a stem no copy or other language can be told.
    Null options count as absent. Repeated rows come out repeated; other columns are ignored.
    """
    s, e = F.coalesce(F.col(stem).cast("string"), F.lit("")), F.coalesce(F.col(explanation).cast("string"), F.lit(""))
    several = [F.coalesce(F.col(o).cast("string"), F.lit("")) for o in options]
    # Each explode writes down once what the rules after it use several times; a projection would be evaluated anew.
    parts = F.struct(s.alias("s"), e.alias("e"), F.array(*several).alias("o"), F.regexp_replace(e, "(?iu)" + LEAD, "").alias("said"))
    rows = df.select(F.col(id_column).alias("id"), F.col(answer).alias("answer"), F.explode(F.array(parts)).alias("p")).select("id", "answer", "p.*")
    body = F.regexp_replace(F.regexp_replace("said", ASKED, ""), ANSWER_LINE, "")
    parts = F.struct(
        "s", "e", "o", F.lower("e").alias("lowered"), body.alias("body"), squeezed(F.col("said")).alias("said"), squeezed(F.col("e")).alias("whole"), squeezed(body).alias("flat"), squeezed(F.col("s")).alias("asked"),
        F.trim(F.regexp_replace("e", NOTE, "")).alias("text"),
    )
    rows = rows.select("id", "answer", F.explode(F.array(parts)).alias("p")).select("id", "answer", "p.*")
    found = {
        "empty": is_empty(F.col("said"), F.col("whole"), F.col("answer")),
        "refusal": is_refusal(F.col("lowered")),
        "language": is_other_language(F.col("s"), F.col("e")),
        "copy": is_copy(F.col("flat"), F.col("asked"), F.col("body"), F.col("s"), [F.col("o")[i] for i in range(len(options))]),
        "truncated": (F.trim("e") != "") & is_truncated(F.col("text")),
    }
    defects = F.array_compact(F.array(*[F.when(found[name], F.lit(name)) for name in DEFECTS]))
    found = rows.select(F.col("id").alias(id_column), F.explode(F.array(defects)).alias("defects")).filter(F.size("defects") > 0)
    return found.withColumn("defect", F.col("defects")[0])
