"""Problem 6: map freely typed values to the closest entry of a reference list.

Method: a multi-pattern automaton over the names and aliases finds embedded mentions, at word bounds; of the
non-overlapping ones the longest wins; values without a mention go to the similarity of token sets (characters and neighbouring pairs of them).

The reference list is checked to be small (``max_entries``), so it travels to the workers inside the function; the typed
values are mapped where they lie, each distinct value of an Arrow batch once, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.lookalikes import mapping

UNMATCHED = "unmatched"
# What surrounds a name without belonging to it.
NUMBERING = re.compile(r"^\s*(?:제\s*\d+\s*[절장편부]|[(\[]?\d+(?:\.\d+)*[.)\]]|[①-⑳])\s*")
TRAILER = re.compile(r"\s*(?:[(\[][^()\[\]]*[)\]]|-\s*재확인|_v\d+|관련|파트|등|[.,;:])\s*$")
PARTS = re.compile(r"\s*[>/|]\s*|\s+-\s+")
# Particles and joiners that are left out or replaced when a name is typed.
PARTICLE = re.compile(r"(?<=[가-힣])(?:와|과|의)\s+")
JOINER = re.compile(r"(?<=[가-힣])(?:와|과)\s+|\s*·\s*")


@lru_cache(1)
def _table() -> dict[int, str | None]:
    source, target = mapping()
    return {ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)}


def consistent(value: str) -> str:
    return unicodedata.normalize("NFC", value.translate(_table()))


def key_of(value: str) -> str:
    """Letters and digits in lower case."""
    return "".join(c for c in value.lower() if c.isalnum())


def aliases_of(name: str) -> set[str]:
    return {key_of(x) for x in (name, PARTICLE.sub("", name), JOINER.sub(" ", name), JOINER.sub("및", name), PARTICLE.sub("", JOINER.sub("및", name)))} - {""}


def core_parts(value: str) -> list[str]:
    """The value and its parts between separators, without numbering and trailing remarks."""
    parts = []
    for part in [value, *PARTS.split(value)]:
        before = None
        while part != before:
            before, part = part, TRAILER.sub("", NUMBERING.sub("", part))
        if part.strip() and part not in parts:
            parts.append(part)
    return parts


def token_bag(key: str) -> Counter:
    return Counter(key) + Counter(key[i : i + 2] for i in range(len(key) - 1))


def joined(text: str, left: int, right: int) -> bool:
    """Whether the places ``left`` and ``right`` hold Latin letters or digits of one word."""
    return left >= 0 and right < len(text) and all(c.isascii() and c.isalnum() for c in (text[left], text[right]))


class CanonicalMapper:
    """Maps one value to a key of the list; ties go to the entry that comes first."""

    def __init__(self, entries: Iterable[tuple[str, str]], least: float):
        self.least = least
        self.entries = [(k, consistent(n)) for k, n in entries]
        self.automaton = ahocorasick.Automaton()
        named: dict[str, int] = {}
        for i, (_, name) in enumerate(self.entries):
            for alias in aliases_of(name):
                named.setdefault(alias, i)
        for alias, i in named.items():
            self.automaton.add_word(alias, (len(alias), i))
        if named:
            self.automaton.make_automaton()
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.sizes = []
        for i, (_, name) in enumerate(self.entries):
            bag = token_bag(key_of(name))
            self.sizes.append(sum(bag.values()))
            for token, n in bag.items():
                self.postings.setdefault(token, []).append((i, n))
        self.cached = lru_cache(1 << 16)(self._map)

    def mentions(self, value: str) -> list[tuple[int, int, int]]:
        """(start, stop, entry) of the non-overlapping mentions, the longest first and of equals the first.

        Places are those of the value's letters and digits. A mention that begins or ends with a Latin letter or a digit
        has to do so at a word's end, so ``CT`` is none in ``ACTION``; Korean names run on into particles.
        """
        if not len(self.automaton):
            return []
        at = [i for i, c in enumerate(value) if c.isalnum() for _ in c.lower() if _.isalnum()]
        key = key_of(value)
        found = []
        for end, (size, i) in self.automaton.iter(key):
            first, last = at[end - size + 1], at[end]
            if not (joined(value, first - 1, first) or joined(value, last, last + 1)):
                found.append((-size, end - size + 1, i))
        chosen: list[tuple[int, int, int]] = []
        for size, start, i in sorted(found):
            if all(start - size <= a or b <= start for a, b, _ in chosen):
                chosen.append((start, start - size, i))
        return chosen

    def closest(self, value: str) -> tuple[float, int | None]:
        """Highest overlap of token bags (twice the shared over all) of any part with any entry."""
        best: tuple[float, int | None] = (0.0, None)
        for part in core_parts(value):
            bag = token_bag(key_of(part))
            size, shared = sum(bag.values()), Counter()
            for token, n in bag.items():
                for i, m in self.postings.get(token, ()):
                    shared[i] += min(n, m)
            for i, n in shared.items():
                score = 2 * n / (size + self.sizes[i])
                if score > best[0] or score == best[0] and best[1] is not None and i < best[1]:
                    best = (score, i)
        return best

    def _map(self, value: str) -> str | None:
        value = consistent(value)
        if not value.strip():
            return None
        mentions = self.mentions(value)
        if mentions:
            return self.entries[mentions[0][2]][0]
        score, found = self.closest(value)
        return UNMATCHED if found is None or score < self.least else self.entries[found][0]

    def map(self, value: str | None) -> str | None:
        return None if value is None else self.cached(value)


def list_entries(reference: DataFrame, key_column: str, name_column: str, max_entries: int) -> list[tuple[str, str]]:
    """The list's (key, name) rows in key order, null and blank names left out; an error beyond ``max_entries``."""
    rows = reference.select(F.col(key_column).cast("string").alias("k"), F.col(name_column).alias("n")).filter("k IS NOT NULL AND trim(n) <> ''").distinct()
    found = rows.limit(max_entries + 1).collect()
    if len(found) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries")
    return sorted((r.k, r.n) for r in found)


def listed_names(reference: DataFrame, name_column: str, max_entries: int = 50_000) -> list[str]:
    """The list's distinct names as written, with the same bound."""
    return sorted({n for _, n in list_entries(reference, name_column, name_column, max_entries)})


def mapper_udf(entries: list[tuple[str, str]], least: float) -> Callable:
    held: list[CanonicalMapper] = []

    @F.pandas_udf(T.StringType())
    def mapped(values: pd.Series) -> pd.Series:
        if not held:
            held.append(CanonicalMapper(entries, least))
        codes, uniques = pd.factorize(values, use_na_sentinel=True)
        keys = [held[0].map(v) for v in uniques] + [None]
        return pd.Series([keys[c] for c in codes], dtype=object)

    # Declared nondeterministic, so that a filter on the key does not make the planner map each value twice.
    return mapped.asNondeterministic()


def map_to_list(
    df: DataFrame, id_columns: list[str], value_column: str, reference: DataFrame, key_column: str, name_column: str, least: float = 0.45, max_entries: int = 50_000
) -> DataFrame:
    """One row per input row: ``id_columns``, ``value`` and ``canonical_key``.

    Null and blank values have the key null, values without a close entry ``unmatched`` (all of them if the list is
    empty). Of equally close entries the one with the smaller key is taken. Repeated rows are kept and other columns
    ignored. The list may hold ``max_entries`` rows, beyond which an error is raised rather than entries dropped.
    """
    entries = list_entries(reference, key_column, name_column, max_entries)
    value = F.col(value_column)
    return df.select(*id_columns, value.alias("value"), mapper_udf(entries, least)(value).alias("canonical_key"))
