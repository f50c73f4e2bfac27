"""Problem 4: traces of scanned pages in text, and the text without them.

Method: each line is labelled body, header, page number, break or marked (body with misrecognised characters, stray marks
or a word cut by a hyphen) by a linear-chain conditional model over layout features, marks and the words of the line; the
best labels are found by Viterbi decoding, a row is affected if one of its lines is a header, a page number or marked,
and paragraphs are put together from the body and marked lines.

The weights are learned from a bounded sample of the rows themselves: lines on which several rules agree are the
examples, and the words that lines of one label have more often than others become features, so neither titles nor
weights are typed in. What no single row can tell, that a word is cut at a line end or misread, comes from word counts
over all rows, aggregated in Spark.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import cut_lineage

BODY, HEADER, PAGE, BREAK, MARKED = LABELS = range(5)
# How letters, digits and syllables are misread (right, wrong).
SYLLABLES = dict(zip("온올률징초섬괸엉겸접랑울학질활밤", "은을를정조선관영검점량율확절촬방"))
LETTERS = (("rn", "m"), ("ii", "u"), ("c", "e"), ("b", "h"), ("vv", "w"))
DIGITS = str.maketrans("lIOoSBZb", "11005826")
STRAY_MARK = re.compile(r"[¬¦»`^\\]|(?<!\w)_|_(?!\w)")
PAGE_NUMBER = re.compile(r"^\s*(?:[-–—] ?\d{1,5} ?[-–—]|p\. ?\d{1,5}|\d{1,5} ?/ ?\d{1,5}|제 ?\d{1,5} ?쪽|〔\d{1,5}〕|\[\d{1,5}\]|\d{1,4})\s*$", re.I)
APART = re.compile(r"^\d{1,5}\s{2,}|\s{2,}\d{1,5}$")
GAP = re.compile(r"\S\s{2,}\S")
CLAUSE = re.compile(r"[.!?。,] ")
SENTENCE_END = re.compile(r"[.!?。！？][\"'”’)\]]*\s*$")
ITEM = re.compile(r"^\s*(?:[-•*·▪※]\s|\d{1,2}[.)]\s|[①-⑳])")
CUT = re.compile(r"(?<=[가-힣A-Za-z])-[ \t]*\n[ \t]*(?=[가-힣a-z])")
MISREAD_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?=[lIOoSBZb.]*\d)[\dlIOoSBZb.]*[lIOoSBZb][\dlIOoSBZb.]*(?![A-Za-z])")
MISREAD_INSIDE = re.compile(r"(?<=[a-z])[01](?=[a-z])|(?<=[a-z]{3})[01](?![\w.])")
MISREAD_UNIT = re.compile(r"(?<![A-Za-z])(?:[kcμ]?rn(?=Gy|Sv|L|A|s|g|m)(?:Gy|Sv|L|As?|s|g|m)|[cμ]rn|rnm)(?![A-Za-z])")
LONE_PIPE = re.compile(r"(?<=[^\s|])\|(?=\s|$)|(?<=\s)\|(?=[^\s|])|(?<=\s)\|(?=\s)")
TABLE_PIPE = re.compile(r"\d[\d.,:]*\s?[^\s|]{0,8}[¬¦»`^_\\ ]* \|")

SHORT = 48  # characters; running headers have seldom more, but any line can become one
LAYOUT = ("number set apart", "wide gap", "angle brackets", "bar between", "section name")  # what sets running headers off
PLACE = ("first or last", "interrupts")
MARKS = ("stray mark", "misread number", "misread letter", "misread unit", "stray bar", "cut by hyphen")


def section_pattern(names: Iterable[str]) -> re.Pattern:
    found = sorted({re.escape(n.strip()) for n in names if n and n.strip()}, key=lambda n: (-len(n), n))
    return re.compile(r"(?:^|(?<=[\s|\-<]))(?:" + "|".join(found or ["(?!)"]) + r")\s*>?\s*$")


@lru_cache(8)
def longest_name(sections: re.Pattern) -> int:
    """Characters at the end of a line that hold any of the names."""
    return max(map(len, sections.pattern.split("|"))) + 8


def words_of(line: str) -> list[str]:
    """The words of a short line as features, with every number as 0."""
    return [f"word {w}" for w in dict.fromkeys(re.findall(r"[^\W\d_]+|0|\|", re.sub(r"\d+", "0", line)))] if len(line) <= SHORT else []


def line_features(lines: list[str], sections: re.Pattern) -> list[list[str]]:
    out = []
    whole, reach = "\n".join(lines), longest_name(sections)
    marked = "|" in whole or "-" in whole and CUT.search(whole) or any(p.search(whole) for p in (STRAY_MARK, MISREAD_NUMBER, MISREAD_INSIDE, MISREAD_UNIT))
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            out.append(["blank"])
            continue
        if PAGE_NUMBER.match(text):
            out.append(["page number"])
            continue
        own = ["line", "short" if len(text) <= SHORT else "long"]
        spread = sum(map(len, text.split())) + len(text.split()) - 1 < len(text)  # only then is anything set apart
        bare = APART.sub("", text) if spread else text
        signs = (bare != text, spread and GAP.search(bare), bare.startswith("<") and bare.endswith(">"), " | " in bare and stray_pipes(bare), sections.search(bare, max(0, len(bare) - reach)))
        own += [n if len(text) <= SHORT else f"{n}, long" for n, holds in zip(LAYOUT, signs) if holds]
        own.append(f"{min(len(bare.split()), 9)} words")
        if CLAUSE.search(bare) and not ITEM.match(bare):
            own.append("clause inside")
        own.append("sentence end" if SENTENCE_END.search(text) else "open end")
        if ITEM.match(line):
            own.append("item")
        if i in (0, len(lines) - 1):
            own.append("first or last")
        elif lines[i - 1].strip() and not SENTENCE_END.search(lines[i - 1]):
            own.append("interrupts")
        if marked:
            after = lines[i + 1] if i + 1 < len(lines) else ""
            found = (STRAY_MARK.search(line), MISREAD_NUMBER.search(line), MISREAD_INSIDE.search(line), MISREAD_UNIT.search(line), "|" in line and stray_pipes(line), text.endswith("-") and CUT.search(f"{line}\n{after}"))
            own += [n for n, holds in zip(MARKS, found) if holds]
        out.append(own + words_of(bare))
    return out


def agreed_label(own: list[str], titles: frozenset[str]) -> int | None:
    """The label on which the rules agree, if they do.

    A header has two signs, one of them of layout (or a word known from other headers), and no sentence; a body line is a
    sentence or part of one, an item, long, or short without any sign. A section name after more than six words is no sign.
    """
    if "blank" in own:
        return BREAK
    if "page number" in own:
        return PAGE
    signs = sum(n in own for n in LAYOUT[:4]) + ("section name" in own and not any(f"{n} words" in own for n in (7, 8, 9)))
    title = any(w in titles for w in own)
    is_body = any(n in own for n in ("sentence end", "clause inside", "item", "long"))
    if not is_body and signs + title and signs + 2 * title + any(n in own for n in PLACE) >= 2:
        return HEADER
    if any(n in own for n in MARKS if n != "stray bar" or is_body):
        return MARKED
    return BODY if is_body or not signs and not title and "stray bar" not in own else None


class LineModel:
    """Weights of line features for each label, and of each label after each."""

    def __init__(self, weights: dict[str, tuple[float, ...]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps
        self.swing = 2 * (max(map(max, steps)) - min(map(min, steps)))  # the most that labels around a line can add or take
        self.known: dict[tuple[str, ...], tuple[list[float], int, bool]] = {}

    def scored(self, own: tuple[str, ...]) -> tuple[list[float], int, bool]:
        """A line's score for each label, the best label, and whether no labels around it could change that."""
        found = self.known.get(own)
        if found is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            none = (0.0,) * len(LABELS)
            score = [sum(x) for x in zip(*[self.weights.get(f, none) for f in own])]
            first, second = sorted(score)[:-3:-1]
            found = self.known[own] = (score, score.index(first), first - second > self.swing)
        return found

    def labels_of(self, lines: list[str], sections: re.Pattern) -> list[int]:
        """The most probable labels of the lines (Viterbi, where a line alone does not decide)."""
        scored = [self.scored(tuple(own)) for own in line_features(lines, sections)]
        if all(sure for _, _, sure in scored):
            return [label for _, label, _ in scored]
        steps = self.steps
        best: list[float] = []
        back: list[list[int]] = []
        for score, _, _ in scored:
            if best:
                froms = [max(LABELS, key=lambda a: best[a] + steps[a][b]) for b in LABELS]
                back.append(froms)
                score = [best[a] + steps[a][b] + score[b] for b, a in enumerate(froms)]
            best = score
        label = max(LABELS, key=best.__getitem__)
        out = [label]
        for froms in reversed(back):
            label = froms[label]
            out.append(label)
        return out[::-1]


def rule_examples() -> list[list[str]]:
    """Lines of every sign alone, so that one which is rare in the sample has its weight too."""
    out = [["blank"], ["page number"]] * 6
    for size, end in itertools.product(("short", "long"), ("open end", "sentence end")):
        out += [["line", size, end, *place, mark] for mark in MARKS if mark != "stray bar" or end != "open end" for place in ([], *[[p] for p in PLACE])]
    out += [["line", "short", "open end", sign, place] for sign in LAYOUT for place in PLACE]
    prose = (["sentence end"], ["item", "sentence end"], ["item", "open end"], ["clause inside", "open end"], ["open end"])
    out += [["line", size, *own, *place] for size in ("short", "long") for own in prose for place in ([], *[[p] for p in PLACE])] * 3
    return out


def learned(texts: list[str], sections: re.Pattern, rounds: int = 240) -> LineModel:
    """The model fitted to the lines of the texts on which the rules agree, by multinomial logistic regression.

    First the words are found that lines with two signs of layout and place have at least ten times as often as other lines; they
    count as a sign in the second labelling. Words of fewer than one in 2,000 lines are no features.
    """
    features = [line_features(t.split("\n"), sections) for t in texts]
    lines = [own for text in features for own in text]
    header, other = Counter(), Counter()
    for own in lines:
        (header if agreed_label(own, frozenset()) == HEADER else other).update(f for f in own if f.startswith("word "))
    lines = lines + rule_examples()
    least = max(2, len(lines) // 2_000)
    titles = frozenset(w for w, n in header.items() if n >= least and n >= 10 * other[w])
    known = Counter(f for own in lines for f in own)
    names = {f: i for i, f in enumerate(sorted(f for f, n in known.items() if n >= least or not f.startswith("word ")))}
    labels = [agreed_label(own, titles) for own in lines]
    rows = [([names[f] for f in own if f in names], y) for own, y in zip(lines, labels) if y is not None]
    steps = np.ones((len(LABELS), len(LABELS)))
    at = 0
    for text in features:
        for a, b in zip(labels[at : at + len(text)], labels[at + 1 : at + len(text)]):
            if a is not None and b is not None:
                steps[a, b] += 1
        at += len(text)
    chance = steps.sum(axis=0) / steps.sum()
    steps = np.clip(np.log(steps / steps.sum(axis=1, keepdims=True) / chance), -1, 1)
    weights = np.zeros((len(names), len(LABELS)))
    if rows:
        flat = np.array([i for own, _ in rows for i in own], np.int64)
        begins = np.concatenate(([0], np.cumsum([len(own) for own, _ in rows])[:-1]))
        owner = np.repeat(np.arange(len(rows)), [len(own) for own, _ in rows])
        truth = np.eye(len(LABELS))[[y for _, y in rows]]
        squares = np.full(weights.shape, 1e-6)
        for _ in range(rounds):
            scores = np.add.reduceat(weights[flat], begins, axis=0)
            chances = np.exp(scores - scores.max(axis=1, keepdims=True))
            wrong = chances / chances.sum(axis=1, keepdims=True) - truth
            slope = np.stack([np.bincount(flat, wrong[owner, y], len(names)) for y in LABELS], axis=1) / len(rows) + 1e-6 * weights
            squares += slope**2
            weights -= slope / np.sqrt(squares)
    return LineModel({f: tuple(map(float, weights[i])) for f, i in names.items()}, steps.tolist())


def sampled_texts(rows: DataFrame, most: int) -> list[str]:
    """About ``most`` distinct texts of several lines, drawn by the hash of the text (all of them if there are fewer)."""
    several = rows.filter(F.col("text").contains("\n"))
    many = max(1, several.count())
    drawn = several.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(min(1 << 20, (most << 20) // many)))
    return sorted(r.text for r in drawn.select("text").distinct().collect())


def stray_pipes(text: str) -> list[int]:
    """Places of bars that separate no table cells."""
    cells = {m.end() - 1 for m in TABLE_PIPE.finditer(text)}
    return [m.start() for m in LONE_PIPE.finditer(text) if m.start() not in cells]


def has_traces(text: str, sections: re.Pattern, model: LineModel) -> bool:
    """Whether one text alone shows that it was scanned: some line of it is a header, a page number or marked."""
    return any(label in (HEADER, PAGE, MARKED) for label in model.labels_of(text.split("\n"), sections))


def repaired(text: str, sections: re.Pattern, model: LineModel, fixes: dict[str, str], cuts: set[str]) -> str:
    """The text as paragraphs: without headers, page numbers and marks, words whole and in their right spelling."""
    lines = text.split("\n")
    labels = model.labels_of(lines, sections)
    paragraphs: list[str] = []
    fresh = True
    for line, label in zip(lines, labels):
        if label == BREAK:
            fresh = True
        if label not in (BODY, MARKED):
            continue
        line = line.strip()
        if fresh or ITEM.match(line) or SENTENCE_END.search(paragraphs[-1]) and ITEM.match(paragraphs[-1]) or re.match(r"\d{1,2}\. \S.{0,40}$", paragraphs[-1]) and not SENTENCE_END.search(paragraphs[-1]):
            paragraphs.append(line)
        else:
            before = paragraphs[-1]
            left, right = re.search(r"[가-힣A-Za-z]+$", before), re.match(r"[가-힣A-Za-z]+", line)
            if re.search(r"[가-힣A-Za-z]-$", before) and right:
                paragraphs[-1] = before[:-1] + line
            elif left and right and f"{left[0]}\n{right[0]}" in cuts:
                paragraphs[-1] = before + line
            else:
                paragraphs[-1] = f"{before} {line}"
        fresh = False
    out = "\n".join(paragraphs)
    for place in reversed(stray_pipes(out)):
        out = out[:place] + out[place + 1 :]
    out = STRAY_MARK.sub("", out)
    out = MISREAD_NUMBER.sub(lambda m: m[0].translate(DIGITS), out)
    out = MISREAD_INSIDE.sub(lambda m: "ol"[int(m[0])], out)
    out = MISREAD_UNIT.sub(lambda m: m[0].replace("rn", "m"), out)
    out = re.sub(r"[가-힣]{2,}|[A-Za-z]{3,}", lambda m: fixes.get(m[0], m[0]), out)
    return re.sub(r"[ \t]{2,}", " ", out).strip()


WORDS = r"[가-힣]+|[A-Za-z]+"
DOUBTFUL_WORD = "[" + "".join(SYLLABLES) + "bc]|rn|ii|vv"
BREAKS = r"(?:[가-힣]+|[A-Za-z]+)\n(?:[가-힣]+|[A-Za-z]+)"


def weighted(texts: DataFrame) -> DataFrame:
    """``text`` of all rows with ``weight``, one by the number of rows with the same text; the texts don't move."""
    hashed = texts.select("text", F.xxhash64("text").alias("h"))
    copies = small(cut_lineage(hashed.groupBy("h").agg(F.count("*").alias("copies")).filter("copies > 1")))
    return hashed.join(copies, "h", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))


def canonical_spelling(word: Column) -> Column:
    """The same for a word and all its misreadings, in however many places: every misread form replaced by the right one."""
    for wrong, right in LETTERS:
        if len(wrong) > 1:
            word = F.replace(word, F.lit(wrong), F.lit(right))
    single = [(wrong, right) for wrong, right in LETTERS if len(wrong) == 1] + list(SYLLABLES.items())
    return F.translate(word, "".join(w for w, _ in single), "".join(r for _, r in single))


class Lexicon:
    """Word counts over all texts, the misread words and the words cut at a line end that follow from them.

    ``n`` are the distinct texts with a word, so that copies of one page can't outvote the right spelling, ``uses`` all its
    occurrences; a right form has to be ``times`` as frequent (the whole word of a cut three times) by either. These are
    ratios, alike at every size of the corpus. A word is misread if another of the same canonical spelling has fewer
    misreadable places and is frequent enough.
    """

    def __init__(self, texts: DataFrame, times: int = 20):
        words = weighted(texts).select("weight", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
        words = words.select("weight", F.posexplode(F.array(F.array_distinct("words"), F.col("words"))).alias("again", "words"))
        words = words.select(F.when(F.col("again") == 0, F.col("weight")).otherwise(0.0).alias("weight"), "again", F.explode("words").alias("word"))
        counts = words.groupBy("word").agg(F.greatest(F.lit(1), F.round(F.sum("weight")).cast("long")).alias("n"), F.sum("again").alias("uses"))
        self.counts = cut_lineage(counts)
        spelled = self.counts.filter(F.length("word") > 1).withColumn("canon", canonical_spelling(F.col("word"))).withColumn("places", F.regexp_count("word", F.lit(DOUBTFUL_WORD)))
        right = spelled.select("canon", F.col("word").alias("right"), F.col("n").alias("m"), F.col("uses").alias("m_uses"), F.col("places").alias("right_places")).filter(F.col("m_uses") >= times)
        found = spelled.filter("places > 0").join(right, "canon").filter((F.col("right_places") < F.col("places")) & ((F.col("m") >= times * F.col("n")) | (F.col("m_uses") >= times * F.col("uses"))))
        self.misread = cut_lineage(found.groupBy("word").agg(F.max_by("right", F.struct("m", "m_uses", "right")).alias("right")))
        pairs = texts.filter(F.col("text").contains("\n")).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(BREAKS), F.lit(0)))).alias("pair")).distinct()
        ends = pairs.select("pair", F.substring_index("pair", "\n", 1).alias("x"), F.substring_index("pair", "\n", -1).alias("y"))
        whole = self.counts.select(F.col("word").alias("w"), F.col("n").alias("m"), F.col("uses").alias("m_uses"))
        tried = ends.withColumn("w", F.concat("x", "y")).join(whole, "w")
        for end in ("x", "y"):
            tried = tried.join(self.counts.select(F.col("word").alias(end), F.col("n").alias(f"n{end}"), F.col("uses").alias(f"u{end}")), end)
        self.cuts = cut_lineage(tried.filter((F.col("m") >= 3 * F.least("nx", "ny")) | (F.col("m_uses") >= 3 * F.least("ux", "uy"))).select("pair"))


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def traces_udf(sections: list[str], model: LineModel):
    pattern = section_pattern(sections)

    @F.pandas_udf(T.BooleanType())
    def traces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: has_traces(t, pattern, model))

    return traces


def model_of(rows: DataFrame, sections: list[str], sample: int) -> LineModel:
    """The line model learned from about ``sample`` of the texts."""
    return learned(sampled_texts(rows, sample), section_pattern(sections))


def scanned_rows(
    df: DataFrame, key_columns: list[str], text_column: str, sections: list[str], lexicon: Lexicon | None = None, model: LineModel | None = None, sample: int = 4_000
) -> DataFrame:
    """The distinct keys of the rows that hold a trace of a scanned page.

    Null and empty texts have none. ``lexicon`` and ``model`` are those of the rows, made here if not given; the model is
    fitted to about ``sample`` texts of several lines. ``sections`` are names that running headers carry (at most a few
    thousand). Repeated rows count once; other columns are ignored.
    """
    rows = df.select(*key_columns, F.col(text_column).alias("text")).filter(F.length("text") > 0)
    lexicon, model = lexicon or Lexicon(rows), model or model_of(rows, sections, sample)
    alone = rows.filter(traces_udf(sections, model)("text")).select(*key_columns)
    words = rows.filter(F.col("text").rlike(DOUBTFUL_WORD)).select(*key_columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))).alias("word"))
    words = words.filter(F.col("word").rlike(DOUBTFUL_WORD))
    misread = words.join(small(lexicon.misread.select("word")), "word", "left_semi").select(*key_columns)
    pairs = rows.filter(F.col("text").contains("\n")).select(*key_columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(BREAKS), F.lit(0)))).alias("pair"))
    cut = pairs.join(small(lexicon.cuts), "pair", "left_semi").select(*key_columns)
    return alone.unionByName(misread).unionByName(cut).distinct()


def repaired_texts(df: DataFrame, key_columns: list[str], text_column: str, sections: list[str], sample: int = 4_000) -> DataFrame:
    """The affected rows' keys with ``repaired``, their text as readable paragraphs; other rows have no row here."""
    rows = df.select(*key_columns, F.col(text_column).alias("text")).filter(F.length("text") > 0)
    lexicon, model = Lexicon(rows), model_of(rows, sections, sample)
    affected = rows.join(scanned_rows(df, key_columns, text_column, sections, lexicon, model), key_columns, "left_semi").dropDuplicates(key_columns)
    affected = cut_lineage(affected)
    words = affected.select(*key_columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))).alias("word"))
    fixes = words.join(small(lexicon.misread), "word").groupBy(*key_columns).agg(F.collect_list(F.concat_ws("\t", "word", "right")).alias("fixes"))
    pairs = affected.select(*key_columns, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(BREAKS), F.lit(0)))).alias("pair"))
    cuts = pairs.join(small(lexicon.cuts), "pair").groupBy(*key_columns).agg(F.collect_list("pair").alias("cuts"))
    pattern = section_pattern(sections)

    @F.pandas_udf(T.StringType())
    def mend(texts: pd.Series, own_fixes: pd.Series, own_cuts: pd.Series) -> pd.Series:
        return pd.Series([repaired(t, pattern, model, dict(x.split("\t") for x in (f if f is not None else ())), set(c if c is not None else ())) for t, f, c in zip(texts, own_fixes, own_cuts)], dtype=object)

    return affected.join(fixes, key_columns, "left").join(cuts, key_columns, "left").select(*key_columns, mend("text", "fixes", "cuts").alias("repaired"))
