"""Problem 8: fill containers of a fixed token capacity with whole documents, leaving little room unused.

Method: linear grouping. Large lengths are rounded up to the largest of their group of equal cardinality; how often each
configuration of the few rounded sizes is made is optimised for all of them together, as a linear program whose columns
are generated by a knapsack; what its rounding down leaves is filled one container after the other, the fullest first.
Actual documents are put in the places, and small ones go where they fit best.

A plan needs only how many pieces have each length, and no length exceeds the capacity: the driver holds a table of
that fixed size whatever the number of documents. Documents then find their container by length and rank, ranked in
salted parts so that a frequent length is not one task.
"""

from __future__ import annotations

import base64
import bisect
import importlib.util
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import cut_lineage

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(2)
def encoder(directory: str, vocabulary: str):
    """The public tokenizer in ``directory``; its pattern stands beside the vocabulary."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(directory) / "__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(Path(directory) / vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("granary", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(directory: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        tokenizer = encoder(directory, vocabulary)
        return texts.map(lambda t: 0 if t is None else len(tokenizer.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8"))))

    # Declared nondeterministic, so that the filter on the count does not make the planner tokenise each text twice.
    return count.asNondeterministic()


def fullest(sizes: list[int], counts: list[int], capacity: int) -> tuple[int, ...]:
    """How many of each size make the fullest container that the counts allow."""
    best = np.full(capacity + 1, -1, np.int64)  # the last kind added to reach a sum; -1 where it can't be reached
    best[0] = len(sizes)
    used = np.zeros(capacity + 1, np.int64)
    for kind, (size, count) in enumerate(zip(sizes, counts)):
        if size > capacity or count <= 0:
            continue
        taken = {}
        for total in np.flatnonzero(best >= 0).tolist():
            at, n = total, 0
            while n < count and at + size <= capacity and best[at + size] < 0:
                at += size
                n += 1
                taken[at] = (kind, n)
        for at, (k, n) in taken.items():
            best[at], used[at] = k, n
    at = int(np.flatnonzero(best >= 0).max())
    out = [0] * len(sizes)
    while at:
        kind, n = int(best[at]), int(used[at])
        out[kind] += n
        at -= n * sizes[kind]
    return tuple(out)


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The content of a container with the highest sum of ``values``, any number of each size."""
    worth = np.flatnonzero(values > 1e-12)
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own, gain = sizes[worth], values[worth]
    for room in range(int(own.min()) if len(own) else capacity + 1, capacity + 1):
        fits = own <= room
        totals = best[room - own[fits]] + gain[fits]
        k = int(totals.argmax())
        if totals[k] > best[room - 1] + 1e-12:
            best[room], last[room] = totals[k], worth[fits][k]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), pattern


def optimised(sizes: list[int], counts: list[int], capacity: int, steps: int = 1_500) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often each is made, so that the fewest containers hold nearly all of the counts.

    The linear relaxation over all configurations, by the simplex method with generated columns (Gilmore and Gomory);
    its values are rounded down, so the counts are never exceeded. ``steps`` only bounds the effort: every step's
    solution holds the counts.
    """
    own, wanted = np.array(sizes, np.int64), np.array(counts, float)
    if not len(own):
        return []
    columns = np.diag((capacity // own).astype(float))
    inverse = np.linalg.inv(columns)
    for step in range(steps):
        value, pattern = best_pattern(own, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        made, direction = inverse @ wanted, inverse @ pattern
        ratios = np.where(direction > 1e-9, np.maximum(made, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratios.argmin())
        columns[:, leaves] = pattern
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
        else:
            inverse[leaves] /= direction[leaves]
            others = np.arange(len(own)) != leaves
            inverse[others] -= np.outer(direction[others], inverse[leaves])
    made = np.floor(np.maximum(np.linalg.solve(columns, wanted), 0) + 1e-6).astype(int)
    return [(tuple(int(n) for n in columns[:, j]), int(times)) for j, times in enumerate(made) if times]


class Plan:
    """Containers made from length counts; ``segments`` are (length, first rank, first container, pieces each)."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 32, small: float = 0.1):
        self.capacity, self.segments, self.containers = capacity, [], 0
        self.next_rank: Counter = Counter()
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # unused room: (first container, how many)
        self.rooms: list[int] = []
        lengths = sorted((n for n in counts if 0 < n <= capacity and counts[n] > 0), reverse=True)
        large = [n for n in lengths if n > small * capacity]
        self._place_large(self._grouped(large, counts, groups))
        for n in (n for n in lengths if n <= small * capacity):
            self._place_small(n, counts[n])

    @staticmethod
    def _grouped(large: list[int], counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
        """(rounded size, [[length, count], ...]) of groups of equal cardinality, largest first."""
        total = sum(counts[n] for n in large)
        each, out, filled = max(1, -(-total // groups)), [], 0
        for n in large:
            left = counts[n]
            while left:
                if not out or filled >= each:
                    out.append((n, []))
                    filled = 0
                take = min(left, each - filled)
                out[-1][1].append([n, take])
                filled += take
                left -= take
        merged: dict[int, list[list[int]]] = {}
        for size, members in out:
            merged.setdefault(size, []).extend(members)
        return list(merged.items())

    def _open(self, room: int, first: int, many: int) -> None:
        if room not in self.room or not self.room[room]:
            bisect.insort(self.rooms, room)
        self.room[room].append((first, many))

    def _put(self, length: int, first: int, many: int, each: int) -> None:
        """``each`` pieces of ``length`` into every one of ``many`` containers from ``first`` on."""
        self.segments.append((length, self.next_rank[length], first, each))
        self.next_rank[length] += many * each

    def _place_large(self, groups: list[tuple[int, list[list[int]]]]) -> None:
        sizes, left = [s for s, _ in groups], [sum(c for _, c in m) for _, m in groups]
        stock = [list(m) for _, m in groups]
        for places, times in optimised(sizes, left, self.capacity):
            self._make(places, min([times, *[left[k] // n for k, n in enumerate(places) if n]]), left, stock)
        while any(left):
            places = fullest(sizes, left, self.capacity)
            self._make(places, min(left[k] // n for k, n in enumerate(places) if n), left, stock)

    def _make(self, places: tuple[int, ...], times: int, left: list[int], stock: list[list[list[int]]]) -> None:
        """Take ``times`` containers of a configuration from what is left."""
        if times > 0:
            slots = [k for k, n in enumerate(places) for _ in range(n)]
            for k in slots:
                left[k] -= times
            self._substitute(slots, stock, times)

    def _substitute(self, slots: list[int], stock: list[list[list[int]]], times: int) -> None:
        """Fill ``times`` equal containers with actual lengths, in runs over which no place changes its length."""
        cursors = []
        for k in slots:
            run, need = [], times
            while need:
                length, have = stock[k][-1]
                take = min(have, need)
                run.append([length, take])
                need -= take
                stock[k][-1][1] -= take
                if not stock[k][-1][1]:
                    stock[k].pop()
            cursors.append(run)
        done = 0
        while done < times:
            many = min(run[0][1] for run in cursors)
            for length, each in Counter(run[0][0] for run in cursors).items():
                self._put(length, self.containers, many, each)
            self._open(self.capacity - sum(run[0][0] for run in cursors), self.containers, many)
            for run in cursors:
                run[0][1] -= many
                if not run[0][1]:
                    run.pop(0)
            self.containers += many
            done += many

    def _place_small(self, length: int, count: int) -> None:
        """Best fit: the least room that takes the length, then new containers."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                many = -(-count // (self.capacity // length))
                self._open(self.capacity, self.containers, many)
                self.containers += many
                continue
            room = self.rooms[at]
            first, many = self.room[room].pop()
            if not self.room[room]:
                self.rooms.pop(at)
            each = min(room // length, count)
            filled = min(many, count // each)
            self._put(length, first, filled, each)
            count -= filled * each
            self._open(room - each * length, first, filled)
            if many > filled:
                self._open(room, first + filled, many - filled)


def placed_udf(plan: Plan):
    table = sorted((length << 42 | rank, first, rank, each) for length, rank, first, each in plan.segments)
    keys, first, rank, each = (np.array(x, np.int64) for x in zip(*table)) if table else (np.zeros(0, np.int64),) * 4

    @F.pandas_udf(T.LongType())
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.Series:
        own = lengths.to_numpy(np.int64) << 42 | ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, own, side="right") - 1
        return pd.Series(first[at] + (ranks.to_numpy(np.int64) - rank[at]) // each[at])

    return placed


def ranked(pieces: DataFrame, order: list[str], salts: int = 64) -> DataFrame:
    """``pieces`` with ``rank`` from 0 among those of equal ``tokens``, numbered in salted parts and offset by the parts before."""
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = rows.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("tokens", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(offsets, ["tokens", "salt"]).withColumn("rank", F.col("own") + F.col("offset")).drop("own", "offset", "salt")


def packed(df: DataFrame, id_column: str, text_column: str, capacity: int = 2048, directory: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece, first_token, tokens and container of every piece; a document within the capacity is one piece.

    A longer document is cut into pieces of the full capacity and its rest. Null, empty and token-free texts take no room
    and have no row. Repeated rows of an id count once each, as they are texts of their own. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    counted = df.select(F.col(id_column).alias("id"), token_count(directory, vocabulary)(text_column).alias("size")).filter("size > 0")
    piece = F.posexplode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(capacity))).alias("piece", "first_token")
    pieces = counted.select("id", "size", piece).select("id", "piece", "first_token", F.least(F.col("size") - F.col("first_token"), F.lit(capacity)).alias("tokens"))
    pieces = cut_lineage(pieces)
    counts = {r.tokens: r["n"] for r in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)
    return ranked(pieces, ["id", "piece"]).select("id", "piece", "first_token", "tokens", placed_udf(plan)("tokens", "rank").alias("container"))
