"""Problem 9: documents that hold passages of evaluation items, equal or with small edits.

Method: SimHash fingerprints of windows. Items give a window at every place, documents one every ``STRIDE`` characters.
Multi-index blocks of the fingerprint guarantee that all item windows within the radius are found: of 64 bits in 4
blocks, two prints at most 7 bits apart differ in at most one bit of some block, so each block is looked up as it is and
with each bit flipped. Weighted shingle similarity then verifies the candidates, and the verified windows are put
together: the longest equal run through them, and the share of the item's characters that lie in one.

A common run of ``least`` characters always holds a document window that equals an item window, so no equal passage of
that length is missed; a passage with an edit every 60 characters is found by the windows within the radius.

The items are a held-out set of checked size (``max_items``) and travel to the workers; documents are read once and never
shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.shared_spans import BASES, Hasher

IGNORED = re.compile(r"[\W_]+")
SHINGLE = 5
STRIDE = 32
WINDOW = 2 * STRIDE  # shingles; a window spans WINDOW + SHINGLE - 1 characters
SPAN = WINDOW + SHINGLE - 1
BLOCKS = 4  # of 16 bits
RADIUS = 2 * BLOCKS - 1  # prints this near differ in at most one bit of some block
AT_ONCE = 4096  # document windows looked up together
FLIPS = np.array([0, *(1 << b for b in range(16))], np.int64)


def squeezed(text: str) -> str:
    """Letters and digits in lower case."""
    return IGNORED.sub("", text.lower())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingle_hashes(codes: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A hash for each run of SHINGLE characters."""
    n = len(codes) - SHINGLE + 1
    return hasher.windows(hasher.prefix(codes), np.arange(n), SHINGLE) if n > 0 else np.zeros(0, np.uint64)


def bit_counts(hashes: np.ndarray, size: int) -> np.ndarray:
    """Per whole group of ``size`` hashes, how many have each of the 64 bits set."""
    groups = len(hashes) // size
    bits = np.unpackbits(hashes[: groups * size].view(np.uint8)).reshape(groups, size, 64)
    return bits.sum(axis=1, dtype=np.uint8)


def fingerprints(counts: np.ndarray) -> np.ndarray:
    """SimHash from the counts of set bits among WINDOW shingles."""
    return np.packbits((counts > WINDOW // 2).astype(np.uint8), axis=1).view(np.uint64).ravel()


class ItemIndex:
    """Fingerprints of all item windows by block, and the exact checks."""

    def __init__(self, items: Sequence[tuple[str, str]], similarity: float):
        self.hasher = Hasher(BASES[0])
        self.similarity = similarity
        self.bags: dict[tuple[int, int], tuple[Counter, float]] = {}
        self.names = [n for n, _ in items]
        self.texts = [squeezed(t) for _, t in items]
        rarity: Counter = Counter()
        prints, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, text in enumerate(self.texts):
            hashes = shingle_hashes(codes_of(text), self.hasher)
            rarity.update(set(text[j : j + SHINGLE] for j in range(len(text) - SHINGLE + 1)))
            n = len(hashes) - WINDOW + 1
            if n <= 0:
                continue
            bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).astype(np.int32)
            total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0)))
            prints.append(fingerprints(total[WINDOW:] - total[:-WINDOW]))
            owner.append(np.full(n, i))
            place.append(np.arange(n))
        self.prints, self.owner, self.place = np.concatenate(prints), np.concatenate(owner), np.concatenate(place)
        self.weights = {s: 1 / n for s, n in rarity.items()}
        self.blocks = []
        for b in range(BLOCKS):
            keys = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((order, np.searchsorted(keys[order], np.arange(65537))))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) of every pair within the radius."""
        found = [np.zeros((0, 2), np.int64)]
        for b, (order, bounds) in enumerate(self.blocks):
            own = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            keys = (own[:, None] ^ FLIPS).ravel()
            low, count = bounds[keys], bounds[keys + 1] - bounds[keys]
            left = np.repeat(np.repeat(np.arange(len(prints)), len(FLIPS)), count)
            if not len(left):
                continue
            step = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            right = order[np.repeat(low, count) + step]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
            found.append(np.stack((left[near], right[near]), axis=1))
        pairs = np.concatenate(found)
        return tuple(np.unique(pairs, axis=0).T) if len(pairs) else (pairs[:, 0], pairs[:, 1])

    def weighed(self, text: str, at: int) -> tuple[Counter, float]:
        """The shingles of the window and their whole weight, rare ones among the items counting more."""
        bag = Counter([text[i : i + SHINGLE] for i in range(at, at + WINDOW)])
        return bag, sum([self.weights.get(s, 1.0) * n for s, n in bag.items()])

    def of_item(self, item: int, place: int) -> tuple[Counter, float]:
        found = self.bags.get((item, place))
        if found is None:
            if len(self.bags) > 1 << 14:
                self.bags.clear()
            found = self.bags[item, place] = self.weighed(self.texts[item], place)
        return found

    def alike(self, own: tuple[Counter, float], other: tuple[Counter, float]) -> bool:
        """Whether the weighted Jaccard similarity of the shingles reaches the threshold."""
        (x, all_x), (y, all_y) = own, other
        shared = sum([self.weights.get(s, 1.0) * min(x[s], y[s]) for s in x.keys() & y.keys()])
        return shared >= self.similarity * (all_x + all_y - shared)

    def longest_run(self, text: str, item: str, shift: int) -> int:
        """Length of the longest equal run of the text with the item moved by ``shift`` places."""
        x, y = codes_of(text[max(0, shift) : len(item) + shift]), codes_of(item[max(0, -shift) :])
        size = min(len(x), len(y))
        breaks = np.flatnonzero(np.concatenate(([True], x[:size] != y[:size], [True])))
        return int(np.diff(breaks).max()) - 1

    def search(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each text and item with a verified window: longest equal run through one, characters of the item in one."""
        prints, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, text in enumerate(texts if len(self.prints) else ()):
            counts = bit_counts(shingle_hashes(codes_of(text), self.hasher), STRIDE)
            if len(counts) > 1:
                prints.append(fingerprints(counts[:-1] + counts[1:]))
                owner.append(np.full(len(counts) - 1, row))
                place.append(np.arange(len(counts) - 1) * STRIDE)
        whole, rows, places = np.concatenate(prints), np.concatenate(owner), np.concatenate(place)
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        shifts: dict[tuple[int, int], set[int]] = {}
        covered: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for first in range(0, len(whole), AT_ONCE):
            own, at_own = (Counter(), 0.0), None
            for left, right in zip(*self.candidates(whole[first : first + AT_ONCE])):
                row, at, i, place = int(rows[first + left]), int(places[first + left]), int(self.owner[right]), int(self.place[right])
                text, item = texts[row], self.texts[i]
                same = text[at : at + SPAN] == item[place : place + SPAN]
                if not same:
                    if at_own != (row, at):
                        own, at_own = self.weighed(text, at), (row, at)
                    if not self.alike(own, self.of_item(i, place)):
                        continue
                covered.setdefault((row, i), []).append((place, place + SPAN))
                shifts.setdefault((row, i), set()).add(at - place)
        for (row, i), spans in covered.items():
            found[row][i] = (max(self.longest_run(texts[row], self.texts[i], n) for n in shifts[row, i]), union_length(spans))
        return found


def union_length(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for low, high in sorted(spans):
        total += max(0, high - max(low, reach))
        reach = max(reach, high)
    return total


@lru_cache(2)
def item_index(items: tuple[tuple[str, str], ...], similarity: float) -> ItemIndex:
    """The index of these items, built once a worker process."""
    return ItemIndex(items, similarity)


def leaked_items(
    df: DataFrame, id_column: str, text_column: str, items: DataFrame, item_column: str, item_text_column: str, least: int = 100, similarity: float = 0.8, max_items: int = 20_000
) -> DataFrame:
    """id, item, run and share, one row for each document with a window that is like one of the item.

    ``run`` is the longest equal run of letters and digits where such a window lies, ``share`` the part of the item's letters
    and digits that lie in one: an equal passage of ``least`` characters or more always has a row with its length as
    ``run``, an edited one has a row with a shorter run. Null and short texts and items give no row; of repeated rows or items each pair comes out once. Other columns are
    ignored. ``least`` must be at least SPAN + STRIDE - 1, else a common run could miss every window. More than
    ``max_items`` items raise an error rather than being dropped.
    """
    if least < SPAN + STRIDE - 1:
        raise ValueError(f"least must be {SPAN + STRIDE - 1} or more")
    rows = items.select(F.col(item_column).cast("string").alias("i"), F.col(item_text_column).alias("t")).dropna().distinct().limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items")
    shipped = df.sparkSession.sparkContext.broadcast(tuple(sorted((r.i, r.t) for r in rows)))
    kind = df.select(id_column).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("item", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = item_index(shipped.value, similarity)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            keys, texts = batch.column("id"), batch.column("text").to_pylist()
            for low in range(0, len(texts), 256):
                for row, items_of_row in enumerate(index.search([squeezed(t) for t in texts[low : low + 256]])):
                    for i, (n, inside) in items_of_row.items():
                        for column, value in zip(out, (keys[low + row].as_py(), index.names[i], n, inside / len(index.texts[i]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("id").type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())], schema.names)

    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.length("text") >= SPAN)
    found = texts.mapInArrow(run, schema)
    return found.groupBy("id", "item").agg(F.max("run").alias("run"), F.max("share").alias("share"))
