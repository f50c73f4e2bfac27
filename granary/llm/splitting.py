"""Problem 3: cut oversized texts at natural boundaries with an overlap.

Method: the text starts as atomic segments; adjacent pairs lie in a heap and the weakest boundary is merged first while
the combined size plus the overlap fits the limit. Python returns offsets only; Spark cuts the text.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strength of the boundary that ends a segment; a merge removes the weakest first.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0
BOUNDARIES = (
    (PARAGRAPH, re.compile(r"\n[ \t\r]*\n\s*|\f\s*")),
    (LINE, re.compile(r"\n\s*")),
    (SENTENCE, re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+|(?<=[。！？])")),
    (CLAUSE, re.compile(r"(?<=[,;:，、])\s*")),
    (SPACE, re.compile(r"\s+")),
)
PAGE_MARK = re.compile(r"(?m)^[ \t]*(?:- ?(\d{1,5}) ?-|p\. ?(\d{1,5})|(\d{1,5}) ?/ ?\d{1,5}|제 ?(\d{1,5}) ?쪽|〔(\d{1,5})〕)[ \t]*$")


def atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """Ends and boundary strengths of the atomic segments: sentences, and finer where one exceeds ``room``."""
    ends: list[int] = []
    strengths: list[int] = []

    def cut(start: int, stop: int, level: int, outer: int) -> None:
        if stop - start <= room and level > 2:
            ends.append(stop)
            strengths.append(outer)
        elif level == len(BOUNDARIES):
            for end in range(start + room, stop, room):
                ends.append(end)
                strengths.append(NONE)
            ends.append(stop)
            strengths.append(outer)
        else:
            strength, pattern = BOUNDARIES[level]
            at = start
            for m in pattern.finditer(text, start, stop):
                if at < m.end() < stop:
                    cut(at, m.end(), level + 1, strength)
                    at = m.end()
            cut(at, stop, level + 1, outer)

    cut(0, len(text), 0, NONE)
    return ends, strengths


def split_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, fresh, stop) of each piece: it shows text[start:stop], of which text[start:fresh] repeats the piece before.

    Every piece has at most ``limit`` characters; the fresh parts cover the text exactly once, in order.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    ends, strengths = atoms(text, room)
    n = len(ends)
    starts = [0, *ends[:-1]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strengths[i], ends[i + 1] - starts[i], i, ends[i], ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or ends[i] != mid or (j := after[i]) >= n or ends[j] != stop:
            continue
        if stop - starts[i] > (limit if starts[i] == 0 else room):
            continue
        ends[i], strengths[i], after[i], alive[j] = stop, strengths[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strengths[i], ends[after[i]] - starts[i], i, stop, ends[after[i]]))
        if before[i] >= 0:
            heapq.heappush(heap, (strengths[before[i]], stop - starts[before[i]], before[i], ends[before[i]], stop))
    return [(max(0, starts[i] - overlap), starts[i], ends[i]) for i in range(n) if alive[i]]


def page_breaks(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """(offset, page) of page marks inside the text whose numbers rise within first..last."""
    marks, page = [], first
    for m in PAGE_MARK.finditer(text):
        number = int(next(g for g in m.groups() if g))
        if page <= number <= last:
            marks.append((m.start(), number))
            page = number
    return marks


def page_at(offset: int, size: int, first: int, last: int, marks: list[tuple[int, int]]) -> int:
    """Page of a character: in proportion between the ends and the page marks."""
    a, pa, b, pb = 0, first, max(size, 1), last + 1
    for at, number in marks:
        if at <= offset:
            a, pa = at, number
        else:
            b, pb = at, max(number, pa)
            break
    return min(last, int(pa + (pb - pa) * (offset - a) / max(b - a, 1)))


PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("fresh", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
            T.StructField("page_start", T.IntegerType()),
            T.StructField("page_end", T.IntegerType()),
        ]
    )
)


def bounds_udf(limit: int, overlap: int):
    @F.pandas_udf(PIECES)
    def bounds(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, first, last):
            pieces = []
            known = not (pd.isna(a) or pd.isna(b))
            marks = page_breaks(t, int(a), int(b)) if known else []
            for start, fresh, stop in split_bounds(t, limit, overlap):
                pages = [page_at(x, len(t), int(a), int(b), marks) for x in (start, stop - 1)] if known else [None, None]
                pieces.append({"start": start, "fresh": fresh, "stop": stop, "page_start": pages[0], "page_end": pages[1]})
            out.append(pieces)
        return pd.Series(out)

    return bounds


def token_estimate(text: Column) -> Column:
    """A third of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("int")


def split_oversized(
    df: DataFrame, id_column: str, text_column: str, page_start: str | None = None, page_end: str | None = None, limit: int = 1400, overlap: int = 180
) -> DataFrame:
    """Pieces of every text over ``limit`` characters: id, piece, content, overlap_chars, page_start, page_end, token_estimate.

    Texts that are null, empty or fit the limit have no row here: they need no cutting. A page of 0, below 0 or null is
    unknown and taken from the other page; with both unknown a piece's pages are null. A text without any boundary is cut
    hard. Repeated rows come out repeated; other columns are ignored, whatever their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    def page(name: str | None) -> Column:
        return F.when(F.col(name) > 0, F.col(name).cast("int")) if name else F.lit(None).cast("int")

    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), page(page_start).alias("_a"), page(page_end).alias("_b"))
    large = rows.filter(F.length("_text") > limit).select(
        "_id", "_text", F.coalesce(F.least("_a", "_b"), "_a", "_b").alias("_first"), F.coalesce(F.greatest("_a", "_b"), "_a", "_b").alias("_last")
    )
    pieces = large.select("_id", "_text", F.posexplode(bounds_udf(limit, overlap)("_text", "_first", "_last")).alias("_n", "_p"))
    content = F.substring(F.col("_text"), F.col("_p.start") + 1, F.col("_p.stop") - F.col("_p.start"))
    return pieces.select(
        F.col("_id").alias(id_column),
        F.col("_n").alias("piece"),
        content.alias("content"),
        (F.col("_p.fresh") - F.col("_p.start")).alias("overlap_chars"),
        F.col("_p.page_start").alias("page_start"),
        F.col("_p.page_end").alias("page_end"),
        token_estimate(content).alias("token_estimate"),
    )
