"""Ranking, quota and sequence operators on windows."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order (with the order reversed: the last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def fill_quota(pool: DataFrame, quotas: DataFrame, keys: list[str], need: str, order: list[Column]) -> DataFrame:
    """The first ``need`` rows of the pool for each key; needs of a repeated key are added up.

    Rows are ranked first in salted parts of a key, of which no more than the need can be taken, then among those left.
    """
    wanted = quotas.groupBy(*keys).agg(F.sum(need).alias("_need")).filter("_need > 0")
    rows = pool.join(wanted, keys).withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in pool.dtypes if not t.startswith("map")]), F.lit(64)))
    for parts in ([*keys, "_salt"], keys):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter(F.col("_n") <= F.col("_need"))
    return rows.drop("_n", "_need", "_salt")


def consecutive_pairs(df: DataFrame, partition: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Rows (0,1), (2,3), ... of each partition side by side; an odd last row has no pair."""
    rows = numbered_within(df, partition, order, "_n").withColumn("_n", F.col("_n") - 1).withColumn("pair", F.floor(F.col("_n") / 2))
    sides = [F.max(F.when(F.col("_n") % 2 == i, F.col(c))).alias(f"{c}_{i + 1}") for i in (0, 1) for c in keep]
    return rows.groupBy(*partition, "pair").agg(*sides, F.count("*").alias("_size")).filter("_size = 2").drop("_size")


def round_robin(df: DataFrame, partition: list[str], order: list[Column], n: int, name: str = "target") -> DataFrame:
    """``df`` with 1 to ``n`` in turn within each partition."""
    return numbered_within(df, partition, order, name).withColumn(name, ((F.col(name) - 1) % n + 1).cast("int"))


def fanned_out(df: DataFrame, count: Column, name: str = "variant") -> DataFrame:
    """Each row ``count`` times, numbered from 0; none for a count of 0 or less."""
    return df.filter(count > 0).withColumn(name, F.explode(F.sequence(F.lit(0), count - 1)))


def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in sorted ranges with ``_part``, written down once: the bounds are drawn from a sample, anew at each run."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Every row's place in the whole order, from 1: ranges are sorted and counted side by side, no task has all rows."""
    ordered = _in_ranges(df, order)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ordered.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """Every row's place within its key, from 1; a key that holds a third of all rows lies in many ranges, in no one task.

    The place in the whole order is counted from the first of the key, so only (key, first place) is aggregated.
    """
    everything = cut_lineage(numbered(df, [*[F.asc(k) for k in keys], *order], "_at"))
    firsts = everything.groupBy(*keys).agg(F.min("_at").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    joined = everything.alias("r").join(firsts.alias("f"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._at") - F.col("f._first") + 1).alias(name))


def neighbours(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """``df`` with ``before`` and ``after``, the column's value in the rows beside it within the key (null at the ends)."""
    rows = cut_lineage(numbered(df, [*[F.asc(k) for k in keys], *order], "_at"))
    out = rows
    for name, step in (("before", 1), ("after", -1)):
        beside = rows.select((F.col("_at") + step).alias("_at"), F.struct(*keys).alias(f"_{name}_key"), F.col(column).alias(name))
        out = out.join(beside, "_at", "left").withColumn(name, F.when(F.struct(*keys).eqNullSafe(F.col(f"_{name}_key")), F.col(name))).drop(f"_{name}_key")
    return out.drop("_at")


def filled_forward(df: DataFrame, column: str, keys: list[str], order: list[str], name: str = "filled") -> DataFrame:
    """``df`` with the last value of the column that is not null, before or at the row, within the key (``order`` ascending).

    Ranges are filled side by side; only each range's last key and value go on to the ranges after it.
    """
    ordered = _in_ranges(df, [F.asc(c) for c in (*keys, *order)])
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = ordered.withColumn(name, F.last(F.col(column), ignorenulls=True).over(own))
    last = ordered.filter(F.col(column).isNotNull()).groupBy("_part", *keys).agg(F.max_by(F.col(column), F.struct(*order)).alias("_value"))
    carried = last.select(*keys, F.col("_part").alias("_from"), "_value")
    parts = ordered.select("_part", *keys).distinct()
    same = F.col("c._from") < F.col("p._part")
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    lead = parts.alias("p").join(carried.alias("c"), same).groupBy("p._part", *[f"p.{k}" for k in keys]).agg(F.max_by("c._value", "c._from").alias("_lead"))
    match = F.col("l._part") == F.col("r._part")
    for k in keys:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = filled.alias("r").join(lead.alias("l"), match, "left")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce(F.col(f"r.{name}"), F.col("l._lead")).alias(name))


def best_list(df: DataFrame, partition: list[str], order: list[Column], k: int, entry: list[str], name: str = "best") -> DataFrame:
    """The first ``k`` entries of each partition as one list in order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("_n") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_n", *entry)))
    return ranked.groupBy(*partition).agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in entry])).alias(name))


def backfilled(pool: DataFrame, taken: DataFrame, targets: DataFrame, key: str, id_column: str, target: str, order: list[Column]) -> DataFrame:
    """Rows of the pool not taken yet, for each key as many as its taken ones are short of the target, in order."""
    have = taken.groupBy(key).agg(F.count("*").alias("_have"))
    short = targets.join(have, key, "left").select(key, (F.col(target) - F.coalesce("_have", F.lit(0))).alias("_short"))
    return fill_quota(pool.join(taken.select(id_column), id_column, "left_anti"), short, [key], "_short", order)


def filled_down(df: DataFrame, columns: list[str], partition: list[str], order: list[Column]) -> DataFrame:
    """Merged cells filled: each column takes the last value above, unless a column before it has a new value since."""
    whole = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out, groups = df, []
    for i, name in enumerate(columns):
        part = Window.partitionBy(*partition, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = F.last(F.col(name), ignorenulls=True).over(part if groups else whole)
        group = f"_g{i}"
        out = out.withColumn(group, F.count(F.col(name)).over(part if groups else whole)).withColumn(name, filled)
        groups.append(group)
    return out.drop(*groups)


def under_headings(df: DataFrame, line: str, levels: dict[str, str], partition: list[str], order: list[Column]) -> DataFrame:
    """Each line that is no heading, with the heading of each level it stands under.

    ``levels`` are patterns from the outermost level in; their first group is the heading. A heading ends those of the
    levels within it.
    """
    named = df
    for name, pattern in levels.items():
        named = named.withColumn(name, F.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, 1)))
    heading = F.coalesce(*levels)
    named = named.withColumn("_heading", heading.isNotNull())
    return filled_down(named, list(levels), partition, order).filter(~F.col("_heading")).drop("_heading")


def expanded(df: DataFrame, count: Column, choices: dict[str, list[str]], name: str = "variant") -> DataFrame:
    """Each row ``count`` times; the variant takes from every list of choices the one at its turn."""
    rows = fanned_out(df, count, name)
    return rows.withColumns({c: F.element_at(F.array(*[F.lit(v) for v in listed]), F.col(name) % len(listed) + 1) for c, listed in choices.items()})


def evenly_spaced(count: Column, wanted: int, skip: int = 0) -> Column:
    """``wanted`` places from ``skip`` to the last of ``count``, evenly spaced and distinct (all places if there are no more)."""
    last = count - 1
    room = last - skip
    spaced = F.transform(F.sequence(F.lit(0), F.lit(max(wanted - 1, 0))), lambda i: (skip + F.floor(i * room / F.lit(max(wanted - 1, 1)) + 0.5)).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda i: (i + skip).cast("int"))
    return F.when(count <= skip, F.array().cast("array<int>")).when(room + 1 <= wanted, every).otherwise(F.array_distinct(spaced))


def page_strip(page: Column, pages: Column, width: int = 10) -> Column:
    """The page numbers shown beside ``page``: its block of ``width``, up to the last page."""
    start = (F.floor((page - 1) / width) * width + 1).cast("int")
    return F.when(pages >= start, F.sequence(start, F.least(pages, start + width - 1))).otherwise(F.array().cast("array<int>"))


def over_fetched(df: DataFrame, partition: list[str], order: list[Column], k: int, keep: Column, times: int = 4) -> DataFrame:
    """Of the first ``k * times`` rows of each partition those to keep, at most ``k``: not the same as to filter first."""
    window = Window.partitionBy(*partition).orderBy(*order)
    fetched = df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k * times).filter(keep)
    return fetched.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy("_n"))).filter(F.col("rank") <= k).drop("_n")


def sampled(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by the hash of seed and id: the same rows each time, and no sort of the whole table."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_column), id_column).limit(n)


def batch_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on; a limit of 0 means all the rest."""
    rows = df.orderBy(*order).offset(max(0, offset))
    return rows.limit(limit) if limit > 0 else rows


def picked(df: DataFrame, id_column: str, wanted: str | None, safe: Column, order: list[Column], index: int = 0) -> DataFrame:
    """The row with the wanted id; without one the first safe row, or if none is safe that at ``index`` in order."""
    if wanted is not None:
        return df.filter(F.col(id_column) == wanted).limit(1)
    firsts = df.withColumn("_safe", F.coalesce(safe, F.lit(False))).orderBy(F.desc("_safe"), *order).limit(1).filter("_safe").drop("_safe")
    rest = df.orderBy(*order).offset(max(0, index)).limit(1)
    either = firsts.withColumn("_tier", F.lit(0)).unionByName(rest.withColumn("_tier", F.lit(1)))
    return either.orderBy("_tier").limit(1).drop("_tier")


def first_seen(df: DataFrame, columns: list[str], position: Column) -> DataFrame:
    """Distinct rows of the columns with the place ``first`` at which each is seen first."""
    return df.groupBy(*columns).agg(F.min(position).alias("first"))


def merged_counts(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Maps of counts added up by key: (keys, name, n)."""
    return df.select(*keys, F.explode(counts).alias("name", "_n")).groupBy(*keys, "name").agg(F.sum("_n").alias("n"))


def group_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with their size ``n`` and place ``rank``, large ones first, then by key."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return numbered(groups, [F.desc("n"), *[F.asc(k) for k in keys]], "rank")


def distinct_pairs(df: DataFrame, group: str, id_column: str, parent: str, score: str, most: int) -> DataFrame:
    """(group, pair, first, second, score): rows of a group in pairs of different parents, the best scores first.

    Greedy: in order of score (then id) each row not yet paired takes the next one of another parent; a group has at most
    ``most`` pairs. A parent gives at most ``most`` rows to them, and rows passed over are of one parent at a time, so the
    first ``3 * most`` rows are enough: no task gets a whole group.
    """
    best, own = Window.partitionBy(group, parent).orderBy(F.desc(score), F.asc(id_column)), Window.partitionBy(group).orderBy(F.desc(score), F.asc(id_column))
    rows = df.select(group, id_column, parent, score).dropna().withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
    rows = rows.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= 3 * most).drop("_n")
    kinds = dict(df.dtypes)

    def paired(rows_of: pd.DataFrame) -> pd.DataFrame:
        found = greedy_pairs(list(zip(rows_of[id_column], rows_of[parent], rows_of[score])), most)
        return pd.DataFrame([(rows_of[group].iloc[0], i, *p) for i, p in enumerate(found)], columns=[group, "pair", "first", "second", "score"])

    return rows.groupBy(group).applyInPandas(paired, f"{group} {kinds[group]}, pair int, first {kinds[id_column]}, second {kinds[id_column]}, score double")


def greedy_pairs(rows: list[tuple[str, str, float]], most: int) -> list[tuple[str, str, float]]:
    """Pairs of (id, parent, score) rows with different parents; the score of a pair is the mean."""
    queue = [(-s, i, p) for i, p, s in rows]
    heapq.heapify(queue)
    out: list[tuple[str, str, float]] = []
    while queue and len(out) < most:
        score, first, parent = heapq.heappop(queue)
        passed = []
        while queue and queue[0][2] == parent:
            passed.append(heapq.heappop(queue))
        if queue:
            other = heapq.heappop(queue)
            out.append((first, other[1], -(score + other[0]) / 2))
        for row in passed:
            heapq.heappush(queue, row)
    return out
