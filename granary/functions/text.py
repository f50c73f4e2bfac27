"""Text functions as Column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[ \t\r\f\x0B\x{00A0}\x{2007}\x{202F}\x{3000}]"
# Suffixes cut off a word's end; the first of the list that fits is cut.
SUFFIXES = ("으로부터", "으로써", "에서", "으로", "에게", "부터", "까지", "에는", "으로", "의", "을", "를", "은", "는", "이", "가", "과", "와", "도", "만", "에", "로")
NUMBERING = r"(?i)^\s*(?:no\.?\s*\d+[.)]?|#\s*\d+|[(]\d+[)]|\d+(?:\.\d+)+[.)]?|\d+[.)]|[ivx]+[.)])\s*"


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def excerpt(x: Column, limit: int, mark: str = "...") -> Column:
    """The collapsed text, cut after ``limit`` characters with a mark where it is longer."""
    text = collapsed(x)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(mark))).otherwise(text)


def compact_key(x: Column) -> Column:
    """Digits, Latin and Hangul only, in lower case: the key by which names are compared."""
    return F.lower(F.regexp_replace(x, "[^0-9A-Za-z가-힣]+", ""))


def excerpt_within(x: Column, limit: int) -> Column:
    """The collapsed text, cut so that it has ``limit`` characters with a one-character ellipsis."""
    text = collapsed(x)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def without_numbering(x: Column) -> Column:
    """``1.``, ``1.2``, ``1)``, ``(1)``, ``#1``, ``No. 1`` and roman ``iv.`` before a name are dropped."""
    return F.regexp_replace(x, NUMBERING, "")


def composed_key(x: Column) -> Column:
    """The compact key of the composed text without its numbering."""
    return compact_key(without_numbering(nfc(x)))


def clean_page(x: Column) -> Column:
    """Composed text, no-break spaces as spaces, runs of blanks as one, at most one blank line in a row."""
    text = F.regexp_replace(nfc(x), r"[ \t\x0B\f\r\x{00A0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def clean_cell(x: Column) -> Column:
    """The cell's lines as one; a number that stands on the line before its text stays before it."""
    return collapsed(F.regexp_replace(clean_page(x), "\n", " "))


def clean_lines(x: Column) -> Column:
    """Runs of blanks as one space, lines trimmed, blank lines dropped."""
    text = F.regexp_replace(x, BLANK + "+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def sliding_chunks(x: Column, size: int = 1400, overlap: int = 180) -> Column:
    """Pieces of ``size`` characters every ``size - overlap``, ending with the window that reaches the end."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(x) - size) / F.lit(step)).cast("int")))
    pieces = F.transform(starts, lambda i: F.trim(F.substring(x, i * step + 1, F.lit(size))))
    return F.when(F.length(x) > 0, pieces).otherwise(F.array().cast("array<string>"))


def tokens(x: Column, least: int = 2) -> Column:
    """Lower-case runs of digits, Latin and Hangul, at least ``least`` long and not all digits."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[0-9a-z가-힣]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))


def suffix_free(token: Column) -> Column:
    """The word without the first suffix of the list that leaves something of it."""
    return F.regexp_replace(token, "(?<=.)(?:" + "|".join(dict.fromkeys(SUFFIXES)) + ")$", "")


def word_set(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words without suffix, two characters at least, neither all digits nor stop words, in order."""
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit("[0-9a-z가-힣]+"), F.lit(0)), suffix_free)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.isin(*stop)))


def sentences(x: Column) -> Column:
    """Split after ., !, ? or 。 and white space, and at semicolons; trimmed and not empty."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?。])\s+|[;；]"), lambda s: F.trim(s)), lambda s: s != "")


def numbers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def comparable(x: Column) -> Column:
    """Lower case, collapsed, without marks but ``.``, ``%``, ``+`` and ``-``."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), r"(?U)[^\w\s.%+-]", ""))


def contains_text(a: Column, b: Column, least: int = 12) -> Column:
    """Whether ``a``, of at least ``least`` characters, stands in ``b``, both in comparable form."""
    return (F.length(comparable(a)) >= least) & F.contains(comparable(b), comparable(a))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by matching blocks, as the standard library counts it: the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def line_sentences(text: str) -> list[str]:
    """Sentences of each line, white space collapsed."""
    parts = (p for line in text.splitlines() for p in re.split(r"(?<=[.!?。！？])\s+", " ".join(line.split())))
    return [p for p in (" ".join(p.split()) for p in parts) if p]


def packed_sentences(text: str, least: int, most: int) -> list[str]:
    """Sentences joined into segments of at most ``most`` characters; what stays under ``least`` is dropped.

    A sentence over ``most`` closes the segment before it, whatever its size, and is cut every ``most`` characters. If
    nothing is left, the first ``most`` characters of a text of ``least`` or more are the segment.
    """
    out: list[str] = []
    held: list[str] = []

    def close(always: bool) -> None:
        segment = " ".join(held)
        if held and (always or len(segment) >= least):
            out.append(segment)
        held.clear()

    for sentence in line_sentences(text):
        if len(sentence) > most:
            close(True)
            out.extend(" ".join(sentence[i : i + most].split()) for i in range(0, len(sentence), most) if len(sentence[i : i + most]) >= least)
            continue
        if sum(map(len, held)) + len(held) + len(sentence) + 1 > most:
            close(False)
        held.append(sentence)
    close(False)
    whole = " ".join(text.split())
    return out or ([whole[:most]] if len(whole) >= least else [])


def semantic_segments(least: int = 120, most: int = 420):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segments(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else packed_sentences(t, least, most))

    return segments


def paragraph_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size`` characters, each piece led by the last ``overlap`` of the one before.

    A longer paragraph is cut every ``size - overlap`` characters on its own, without a lead.
    """
    out: list[str] = []
    held = ""
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(paragraph) > size:
            out += [held] if held else []
            held = ""
            starts = range(0, max(1, len(paragraph) - overlap), size - overlap)
            out += [paragraph[i : i + size].strip() for i in starts]
        elif paragraph:
            joined = f"{held}\n\n{paragraph}" if held else paragraph
            if len(joined) > size:
                out.append(held)
                joined = f"{held[-overlap:]}\n\n{paragraph}" if overlap else paragraph
            held = joined
    return out + ([held] if held else [])


def paragraph_chunks(size: int = 1400, overlap: int = 180):
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else paragraph_pieces(t, size, overlap))

    return pieces


def ratio_of(a: str, b: str) -> float:
    """Matching-block similarity of the composed, collapsed texts; 0 if one is empty."""
    x, y = (" ".join(unicodedata.normalize("NFC", t).split()) for t in (a, b))
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def window_similarity(text: str, source: str, least: int = 12, step: int = 80, windows: int = 80) -> float:
    """Highest similarity of a sentence of ``text`` with a window of ``source``: twice as long, or 80, every 80 characters.

    The first ``windows`` of them count, which is part of the measure.
    """
    best = 0.0
    for sentence in [s.strip() for s in re.split(r"(?<=[.!?。])|\n", text) if s.strip()] or [text]:
        if len(sentence) >= least:
            starts = range(0, max(1, len(source) - 40), step)[:windows]
            best = max([best, *(ratio_of(sentence, source[i : i + max(80, 2 * len(sentence))]) for i in starts)])
    return best


@F.pandas_udf(T.DoubleType())
def max_window_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else window_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def contains_either(a: Column, b: Column) -> Column:
    """Whether one of the compact keys, both not empty, stands in the other."""
    x, y = compact_key(a), compact_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def boost_terms(x: Column) -> Column:
    """Distinct terms of two characters or more between commas and white space, in order."""
    return F.array_distinct(F.filter(F.split(F.translate(F.coalesce(x, F.lit("")), ",", " "), r"\s+"), lambda t: F.length(t) >= 2))


def any_of(terms: Column) -> Column:
    """An OR query for a text index: quoted terms."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def slug(x: Column, limit: int = 80) -> Column:
    """Letters, digits, dots, hyphens and underscores; the rest becomes one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(x, "[^0-9A-Za-z가-힣._-]+", "_"), "^_+|_+$", ""), 1, limit)


def html_escaped(x: Column) -> Column:
    out = x
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def html_to_text(x: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, blocks as lines, tags removed, the common entities resolved."""
    out = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</?(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article)\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]\s*>", " "), r"<[^>]*>", "")
    for code, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return clean_lines(out)


def markdown_row(cells: Column) -> Column:
    """One row of a table: cells on one line, bars escaped, null as empty."""
    shown = F.transform(cells, lambda c: F.replace(collapsed(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def wrapped(x: Column, width: int = 42, lines: int = 3) -> Column:
    """The first lines of the collapsed text, broken at spaces where a line has one."""
    found = F.regexp_extract_all(collapsed(x), F.lit(rf"\S.{{0,{width - 1}}}(?=\s|$)|\S{{{width}}}"), F.lit(0))
    return F.slice(found, 1, lines)


def level_marker(x: Column) -> Column:
    """A, B or C of the first ``(A)`` marker, else null."""
    return F.nullif(F.regexp_extract(x, "[(]([ABC])[)]", 1), F.lit(""))


def without_level_marker(x: Column) -> Column:
    return collapsed(F.regexp_replace(x, r"^([^(]*(?:[(](?![ABC][)])[^(]*)*)[(][ABC][)]", "$1"))


def keyword_hits(x: Column, keywords: list[str]) -> Column:
    """The keywords that stand in the text, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(x, k))


def unique_labels(labels: Column, width: int = 28, most: int = 7) -> Column:
    """The first distinct labels that are not blank, collapsed and cut."""
    shown = F.transform(labels, lambda v: F.substring(collapsed(F.coalesce(v, F.lit(""))), 1, width))
    return F.slice(F.array_distinct(F.filter(shown, lambda v: v != "")), 1, most)


def numbers_with_units(x: Column) -> Column:
    """Distinct numbers with the unit that follows, blanks between them dropped."""
    found = F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?\s*(?:%|[A-Za-zμ°]+(?:/[A-Za-z]+)?)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, r"\s+", "")))
