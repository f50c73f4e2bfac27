"""Problem 7: long passages that stand in more than one record, and the share of each record they cover.

Method: difference-cover anchors. Windows are hashed only where their position modulo a period lies in a difference
cover, so two copies of a passage of at least ``length`` characters always have an anchor at the same place of the
passage. Anchors met in two records are then extended: every window of ``length`` characters over such an anchor is
hashed in 96 bits, and those met in two records are the shared characters.

Nothing is paired: hashes are aggregated before they move, so a passage in a third of all records costs one row a task.
The shared hashes go back to the texts as a Bloom filter, sized from their count so that about one place in a thousand
passes unduly (``FILTER_BITS`` and ``FILTER_PROBES``); it lets no shared hash through unseen, and what passes unduly is
told apart by the exact grouping and join after it. Tasks build the filter in blocks, and the driver passes them on in
pieces of at most 8 MB (``PIECE_BITS``), one after the other. Where the filter would exceed ``most_bits``, places travel
to the texts by a shuffled semi join, and windows straight to the join, so that the work stays linear at any size. Joins
with hashes ask for a shuffled join (``merge``), as the planner takes these sides for smaller than they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.scans import small
from granary.session import cut_lineage

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SLICE = 1 << 20
FILTER_BITS = 16  # bits a hash; with six probes one other hash in a thousand passes
BLOCK_BITS, PIECE_BITS = 23, 26  # all probes of a hash lie in one block, which one task builds; a piece holds whole blocks
FILTER_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)


def difference_cover(period: int) -> list[int]:
    """A set D with every residue a difference of two of its members, found greedily (about 1.5 sqrt(period) members)."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        best = max(range(period), key=lambda c: len({(c - d) % period for d in cover} & missing) + len({(d - c) % period for d in cover} & missing))
        cover.append(best)
        missing -= {(a - b) % period for a in cover for b in (best,)} | {(best - a) % period for a in cover}
    return sorted(cover)


class Hasher:
    """Polynomial hashes, modulo 2^64, of windows over many texts at once."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base | np.uint64(1), np.uint64(pow(int(base | np.uint64(1)), -1, 1 << 64))
        self.powers = self.backward = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers, self.backward = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            self.powers[0] = self.backward[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.backward, out=self.backward)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(7)) * np.uint64(0xFF51AFD7ED558CCD) * self.powers[: len(codes)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = (prefix[at + size] - prefix[at]) * self.backward[at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batch with the code points of their texts, the start of each and the place of each in its text."""
    sizes = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    from_row, total = 0, 0
    for row in range(len(sizes) + 1):
        if row == len(sizes) or total and total + sizes[row] > SLICE:
            if row > from_row:
                part = batch.slice(from_row, row - from_row)
                codes = np.frombuffer("".join(part.column("text").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                own = sizes[from_row:row]
                starts = np.concatenate(([0], np.cumsum(own)[:-1]))
                yield part, codes, starts, own
            from_row, total = row, 0
        if row < len(sizes):
            total += sizes[row]


def anchor_places(starts: np.ndarray, sizes: np.ndarray, period: int, cover: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the anchors: the residue of the place within its text lies in the cover."""
    total = int(sizes.sum())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(total) - starts[rows]
    wanted = np.zeros(period, bool)
    wanted[cover] = True
    at = np.flatnonzero(wanted[inside % period] & (inside + window <= sizes[rows]))
    return rows[at], at


def anchors_of(length: int, period: int, cover: list[int]):
    window = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BASES[0])
        for batch in batches:
            for part, codes, starts, sizes in slices(batch):
                rows, at = anchor_places(starts, sizes, period, cover, window)
                hashes = hasher.windows(hasher.prefix(codes), at, window).view(np.int64)
                records = part.column("record").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(records)], ["hash", "record"])

    return run


class Filter:
    """A Bloom filter over 64-bit hashes; ``pieces`` are broadcasts of its blocks, 2^``each`` blocks in one."""

    def __init__(self, bits: int, held: int, each: int, pieces: list[Broadcast]):
        self.bits, self.held, self.each, self.pieces = bits, held, each, pieces

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        block = ((hashes >> np.uint64(1)) >> np.uint64(63 - self.bits + self.held)).astype(np.int64)
        for n, piece in enumerate(self.pieces):
            at = np.flatnonzero(block >> self.each == n)
            for probe in FILTER_PROBES:
                index = (hashes[at] * probe) >> np.uint64(64 - self.held)
                word = ((block[at] - (n << self.each)) << (self.held - 6)) + (index >> np.uint64(6)).astype(np.int64)
                at = at[(piece.value[word] >> (index & np.uint64(63))) & np.uint64(1) > 0]
            out[at] = True
        return out


def filter_of(hashes: DataFrame, most_bits: int, block_bits: int = BLOCK_BITS, piece_bits: int = PIECE_BITS) -> Filter | None:
    """A filter of the ``hash`` column sized from its count, at most 2^(most_bits - 6) words; None beyond that."""
    bits = max(12, (max(1, hashes.count()) * FILTER_BITS - 1).bit_length())
    if bits > most_bits:
        return None
    held = min(bits, block_bits)
    each = max(0, min(bits, piece_bits) - held)

    def run(group: pa.Table) -> pa.Table:
        own, hit = group.column("hash").to_numpy().view(np.uint64), np.zeros(1 << held, bool)
        for probe in FILTER_PROBES:
            hit[(own * probe) >> np.uint64(64 - held)] = True
        return pa.table({"block": group.column("block").slice(0, 1), "words": pa.array([np.packbits(hit, bitorder="little").tobytes()], pa.binary())})

    block = F.shiftrightunsigned(F.shiftrightunsigned("hash", 1), 63 - bits + held)
    blocks = hashes.select("hash", block.cast("int").alias("block")).groupBy("block").applyInArrow(run, "block int, words binary")
    if bits > held + each:
        blocks = cut_lineage(blocks)
    pieces = []
    for first in range(0, 1 << (bits - held), 1 << each):
        words = np.zeros((1 << each, 1 << (held - 6)), np.uint64)
        for row in blocks.filter(F.col("block").between(first, first + (1 << each) - 1)).collect():
            words[row.block - first] = np.frombuffer(row.words, np.uint64)
        pieces.append(hashes.sparkSession.sparkContext.broadcast(words.ravel()))
    return Filter(bits, held, each, pieces)


def anchor_hits(length: int, period: int, cover: list[int]):
    """Hash, row and place of every anchor, for the join beyond the size of a filter."""
    window = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BASES[0])
        for batch in batches:
            for part, codes, starts, sizes in slices(batch):
                rows, at = anchor_places(starts, sizes, period, cover, window)
                hashes = hasher.windows(hasher.prefix(codes), at, window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), part.column("row").take(pa.array(rows)), pa.array((at - starts[rows]).astype(np.int32))], ["hash", "row", "place"])

    return run


def windows_of(length: int, period: int, cover: list[int], anchors, windows):
    """Windows over the anchors that pass ``anchors`` (or that stand in ``places``), thinned by the filter ``windows``."""
    window = length - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Hasher(BASES[0]), Hasher(BASES[1])
        for batch in batches:
            for part, codes, starts, sizes in slices(batch):
                prefix = first.prefix(codes)
                if anchors is None:
                    places = part.column("places")
                    rows = np.repeat(np.arange(len(sizes)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                    at = places.flatten().to_numpy().astype(np.int64) + starts[rows]
                else:
                    rows, at = anchor_places(starts, sizes, period, cover, window)
                    hit = anchors.marked(first.windows(prefix, at, window))
                    rows, at = rows[hit], at[hit]
                if not len(at):
                    continue
                low = np.maximum(at - (length - window), starts[rows])
                high = np.minimum(at, starts[rows] + sizes[rows] - length) + 1
                kept = low < high
                edges = np.bincount(low[kept], minlength=len(codes) + 1) - np.bincount(high[kept], minlength=len(codes) + 1)
                places = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                h1 = first.windows(prefix, places, length)
                if windows is not None:
                    hit = windows.marked(h1)
                    places, h1 = places[hit], h1[hit]
                if not len(places):
                    continue
                owner = np.searchsorted(starts, places, side="right") - 1
                h2 = (second.windows(second.prefix(codes), places, length) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [pa.array(h1.view(np.int64)), pa.array(h2), part.column("record").take(pa.array(owner)), part.column("row").take(pa.array(owner)), pa.array((places - starts[owner]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "record", "row", "place"])

    return run


def shared_windows(rows: DataFrame, length: int, period: int = 133, most_bits: int = 29) -> DataFrame:
    """(row, record, place) of every window of ``length`` characters that also stands in another record.

    ``rows`` has ``row`` and ``record`` (long) and ``text``; texts shorter than ``length`` or null have no window. Texts
    are read three times (anchors, windows, shared windows) and, within ``most_bits``, never shuffled.
    """
    if not 1 <= period < length:
        raise ValueError("the period must be smaller than the length")
    cover = difference_cover(period)
    long = rows.filter(F.length("text") >= length)
    anchors = long.select("record", "text").mapInArrow(anchors_of(length, period, cover), "hash long, record long")
    shared = cut_lineage(anchors.groupBy("hash").agg(F.min("record").alias("a"), F.max("record").alias("b")).filter("a < b").select("hash"))
    of_anchors = filter_of(shared, most_bits)
    texts = long.select("record", "row", "text")
    if of_anchors is None:
        hits = long.select("row", "text").mapInArrow(anchor_hits(length, period, cover), "hash long, row long, place int").join(shared.hint("merge"), "hash", "left_semi")
        texts = cut_lineage(texts.join(hits.groupBy("row").agg(F.array_distinct(F.collect_list("place")).alias("places")).hint("merge"), "row"))

    def windows(of_windows) -> DataFrame:
        return texts.mapInArrow(windows_of(length, period, cover, of_anchors, of_windows), "h1 long, h2 int, record long, row long, place int")

    both = windows(None).groupBy("h1", "h2").agg(F.min("record").alias("a"), F.max("record").alias("b")).filter("a < b")
    both = cut_lineage(both.select("h1", "h2"))
    found = windows(filter_of(both.select(F.col("h1").alias("hash")), most_bits))
    return found.join(both.hint("merge"), ["h1", "h2"], "left_semi").select("row", "record", "place")


def _sent(df: DataFrame) -> DataFrame:
    """``small``, with a shuffled join asked for beyond its rows."""
    found = small(df)
    return df.hint("merge") if found is df else found


def _keyed(df: DataFrame, key_columns: list[str], record_columns: list[str], text_column: str) -> DataFrame:
    return df.select(*key_columns, F.col(text_column).alias("text"), F.xxhash64(*key_columns).alias("row"), F.xxhash64(*record_columns).alias("record"))


def _spans(keyed: DataFrame, length: int) -> DataFrame:
    """(record, row, start, stop) of the maximal spans, written down once as both the sums and the names need them."""
    windows = shared_windows(keyed.select("row", "record", "text"), length)
    spans = windows.groupBy("record", "row").agg(F.array_sort(F.collect_set("place")).alias("places"))
    spans = spans.select("record", "row", F.explode(merged(F.col("places"), length)).alias("span"))
    return cut_lineage(spans.select("record", "row", "span.start", "span.stop"))


def shared_spans(df: DataFrame, key_columns: list[str], record_columns: list[str], text_column: str, length: int = 200, passage_column: str | None = None) -> DataFrame:
    """Keys, start, stop of the maximal spans made of shared windows, one row a span; rows without one are left out.

    A record is what ``record_columns`` name (part of ``key_columns``, which name one text); the passage must stand in
    another record, so a passage repeated within one record alone is not shared. Null, empty and short texts have no
    span. Repeated rows count once. Places are code points from 0, ``stop`` excluded. ``passage_column`` adds the
    characters of the span under that name. Other columns are ignored.
    """
    keyed = _keyed(df, key_columns, record_columns, text_column)
    spans = _sent(_spans(keyed, length).select("row", "start", "stop"))
    passage = [F.expr("substring(text, start + 1, stop - start)").alias(passage_column)] if passage_column else []
    return keyed.join(spans, "row").select(*key_columns, "start", "stop", *passage).distinct()


def covered_shares(df: DataFrame, key_columns: list[str], record_columns: list[str], text_column: str, length: int = 200) -> DataFrame:
    """A row for each record: characters, those that ``shared_spans`` cover, and the share they are (0 without any text).

    The characters of a record are those of all its texts. Repeated rows count once.
    """
    keyed = _keyed(df, key_columns, record_columns, text_column)
    covered = _sent(_spans(keyed, length).groupBy("record").agg(F.sum(F.col("stop") - F.col("start")).alias("covered")))
    sizes = keyed.select(*key_columns, "record", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct()
    records = sizes.groupBy("record", *record_columns).agg(F.sum("n").alias("characters")).join(covered, "record", "left")
    share = F.coalesce(F.try_divide("covered", "characters"), F.lit(0.0))
    return records.select(*record_columns, "characters", F.coalesce("covered", F.lit(0)).alias("covered"), share.alias("share"))


def merged(places: Column, length: int) -> Column:
    """Spans covered by the windows that start at the sorted ``places``; touching ones become one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(found: Column, place: Column) -> Column:
        last = F.element_at(found, -1)
        fresh = F.struct(place.cast("int").alias("start"), (place + length).cast("int").alias("stop"))
        longer = F.struct(last["start"].alias("start"), (place + length).cast("int").alias("stop"))
        return F.when((F.size(found) > 0) & (F.try_element_at(found, F.lit(-1))["stop"] >= place), F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(found, F.array(fresh)))

    return F.aggregate(places, empty, add)
