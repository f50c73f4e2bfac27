"""Problem 2: bring text that looks the same to the same characters.

Method: characters are mapped to what they look like (one character for another inside the JVM, by ``translate``), values are grouped in SQL under
the accent-sensitive Unicode collation, one canonical member is chosen per equivalence class and joined back.

Values whose characters all belong to the consistent form are their own canonical member, so they skip the grouping:
a class that holds such a value and others takes the same form, because the members offered for choice are composed.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import cut_lineage

# Letters of other scripts that look like a Latin letter; Unicode's own data does not relate them.
CYRILLIC = "АВЕКМНОРСТУХІЈЅаеорсухіјѕԁԛԝһ"
CYRILLIC_AS = "ABEKMHOPCTYXIJSaeopcyxijsdqwh"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"
ARMENIAN = "ՕՍՏԼօսհոցզ"
ARMENIAN_AS = "OUSLouhngq"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏕᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHGZ4SVSLCPKB"
# Dots that look like the middle dot, hyphens, and letters without a glyph that are no format characters.
DOTS = "·ᆞ‧∙⋅・ㆍ･"
HYPHENS = "‐‑"
FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
VARIATION = "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
CONTROL = "".join(map(chr, [*range(1, 9), *range(14, 32), *range(127, 133), *range(134, 160)]))
# Kinds of compatibility characters that look like what they stand for (unlike superscripts, circles and fractions).
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<square>")
SCRIPTS_APART = (range(0x3131, 0x318F), range(0x0600, 0x0700), range(0x0E00, 0x1000), (0x017F,))  # ordinary letters all the same


@lru_cache(1)
def compatible() -> dict[str, str]:
    """Compatibility characters with what they look like, by Unicode's decompositions: wide and styled forms, ligatures, units, numerals."""
    out = {}
    for code in range(0xA0, 0x30000):
        char = chr(code)
        kind, _, _ = unicodedata.decomposition(char).partition(" ")
        if kind not in SAME_LOOK or any(code in r for r in SCRIPTS_APART):
            continue
        own = unicodedata.normalize("NFKC", char) if kind not in ("<wide>", "<narrow>") else chr(int(unicodedata.decomposition(char).split()[1], 16))
        plain = kind in ("<wide>", "<narrow>") or own.isalnum() and not (kind == "<square>" and any(c.isdigit() for c in own))
        if plain and own != char:
            out[char] = own
    return out


@lru_cache(1)
def mapping() -> tuple[str, str]:
    """``translate`` arguments: characters with a partner first, then those to drop."""
    pairs = {c: a for c, a in compatible().items() if len(a) == 1}
    pairs |= dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS))
    invisible = set(FILLERS + VARIATION + CONTROL)
    for code in range(0x80, 0xF0000):
        kind = unicodedata.category(chr(code))
        if kind == "Zs":
            pairs[chr(code)] = " "
        elif kind == "Cf" and "SIGN" not in unicodedata.name(chr(code), "") and "MARK ABOVE" not in unicodedata.name(chr(code), ""):
            invisible.add(chr(code))
    pairs |= {c: "·" for c in DOTS} | {c: "-" for c in HYPHENS} | {"µ": "μ"}
    pairs = {c: a for c, a in pairs.items() if c != a and c not in invisible}
    return "".join(pairs) + "".join(sorted(invisible)), "".join(pairs.values())


@lru_cache(1)
def longer() -> dict[int, str]:
    """Compatibility characters that look like several letters: ligatures, units, numerals."""
    return {ord(c): a for c, a in compatible().items() if len(a) > 1}


@lru_cache(1)
def suspicious_pattern() -> str:
    """A character class of everything that may not be in the consistent form, by the normalization data itself."""
    codes = {ord(c) for c in mapping()[0]} | set(longer()) | {0}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x4E00 <= code <= 0x9FFF:
            continue
        char = chr(code)
        if not unicodedata.is_normalized("NFC", char) or unicodedata.combining(char):
            codes.add(code)
    codes |= {*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD800 - 4)}
    return character_class(codes)


def character_class(codes: Iterable[int]) -> str:
    spans: list[list[int]] = []
    for code in sorted(codes):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    """NFC of each value; Spark has no built-in for it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def lengthened(values: pd.Series) -> pd.Series:
    """Each value with characters that look like several letters replaced by these; Spark has no built-in for it."""
    return values.map(lambda v: None if v is None else v.translate(longer()), na_action="ignore")


# Everyday characters of the consistent form; a value of these alone needs no look at the long class.
EVERYDAY = r"[^\t\n\r -~가-힣一-鿿À-ÿ·°±²³¹×μ①-⓿⁰-\x{209F}]"


def is_suspicious(value: Column) -> Column:
    return value.rlike(EVERYDAY) & value.rlike(suspicious_pattern())


def look_alike_mapped(value: Column) -> Column:
    """``value`` with look-alike, wide and spacing characters replaced and invisible ones dropped (JVM only)."""
    source, target = mapping()
    return F.replace(F.translate(value, source, target), F.lit("\x00"), F.lit(""))


def canonical_classes(forms: DataFrame) -> DataFrame:
    """(form, canonical) for each distinct ``form``: the shortest, then smallest, composed member of its class."""
    return forms.sparkSession.sql(
        """
        SELECT m.form, c.canonical
        FROM {forms} m
        JOIN (SELECT form COLLATE UNICODE AS class, min_by(composed, struct(char_length(composed), composed)) AS canonical
              FROM {forms} GROUP BY form COLLATE UNICODE) c
        ON m.form COLLATE UNICODE = c.class
        """,
        forms=forms,
    )


def consistent_forms(df: DataFrame, id_columns: list[str], value_column: str, only_changed: bool = False) -> DataFrame:
    """One row per input row: ``id_columns``, ``consistent`` and ``changed``.

    Null values stay null and unchanged, the empty string stays empty; a value of invisible characters alone becomes
    empty and counts as changed. Repeated rows are kept. Columns other than the named ones are ignored.
    ``only_changed`` leaves out unchanged rows before anything is shuffled.
    """
    rows = df.select(*id_columns, F.col(value_column).alias("_value"))
    suspect = F.coalesce(is_suspicious(F.col("_value")), F.lit(False))
    form = look_alike_mapped(F.col("_value"))
    several = F.when(F.col("_value").rlike(character_class(longer())), form)
    doubtful = cut_lineage(rows.filter(suspect).withColumn("_form", F.coalesce(lengthened(several), form)))
    forms = doubtful.select(F.col("_form").alias("form")).distinct().withColumn("composed", composed("form"))
    joined = doubtful.join(canonical_classes(forms).withColumnRenamed("form", "_form"), "_form")
    done = joined.select(*id_columns, F.col("canonical").alias("consistent"), (F.col("canonical") != F.col("_value")).alias("changed"))
    if only_changed:
        return done.filter("changed")
    plain = rows.filter(~suspect).select(*id_columns, F.col("_value").alias("consistent"), F.lit(False).alias("changed"))
    return plain.unionByName(done)
