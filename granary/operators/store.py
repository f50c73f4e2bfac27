"""Candidate store operators: upserts, versions and parent rows with their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.sequences import first_per_key


def upserted(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, which keep their ``kept`` columns."""
    own = old.select(key, *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_there"))
    merged = new.join(own, key, "left").select(
        *[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns]
    )
    return old.join(new.select(key), key, "left_anti").unionByName(merged, allowMissingColumns=True)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last version of each key."""
    return first_per_key(df, [key], order)


def with_child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of each child table's rows per parent, 0 where there are none."""
    out = parents
    for name, (child, foreign) in children.items():
        counted = child.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered list; sizes are held within 5 and 100, pages start at 1."""
    size, page = min(100, max(5, size)), max(1, page)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def _same_keys(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def upserted_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys (null equals null); columns only one has stay."""
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), _same_keys(keys, "o", "n"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and ``new``; a key that is there already, or twice in ``new``, ends the job. Null keys get a generated one."""
    made = new.withColumn(key, F.coalesce(key, F.expr("replace(uuid(), '-', '')"))) if dict(new.dtypes)[key] == "string" else new
    there = old.select(key).unionByName(made.select(key)).groupBy(key).agg(F.count("*").alias("_n"))
    checked = made.join(there, key).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))))
    return old.unionByName(checked.filter(F.col("_ok").isNull()).drop("_n", "_ok"), allowMissingColumns=True)


def updated(df: DataFrame, where: Column, values: dict[str, Column], most: int | None = 20) -> DataFrame:
    """``df`` with the values set where the condition holds; refused if it holds for more than ``most`` rows."""
    if most is not None and df.filter(where).limit(most + 1).count() > most:
        raise ValueError(f"the update would change more than {most} rows")
    holds = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(holds, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def deleted(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    """``df`` without the rows in which all the columns have these values; without any condition nothing is deleted."""
    if not equal:
        return df
    holds = F.lit(True)
    for name, value in equal.items():
        holds = holds & F.col(name).eqNullSafe(F.lit(value))
    return df.filter(~holds)


def synced(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """The rows of ``new`` alone, with the ``kept`` columns of ``old`` where the key was there: what ``new`` lacks is deleted."""
    own = old.select(key, *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_there"))
    return new.join(own, key, "left").select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns])


def with_defaults(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns it lacks, filled with their defaults; those it has stay."""
    return df.withColumns({name: value for name, value in columns.items() if name not in df.columns})


def applied_updates(df: DataFrame, updates: DataFrame, key: str, columns: list[str], dry: bool = False) -> DataFrame:
    """``df`` with columns set from ``updates`` by key; dry: only key, old and new values of the rows that would change."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_set"))
    rows = df.join(new, key, "left")
    if dry:
        changes = F.lit(False)
        for c in columns:
            changes = changes | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
        return rows.filter(F.col("_set") & changes).select(key, *[F.col(c).alias(f"old_{c}") for c in columns], *[f"new_{c}" for c in columns])
    return rows.select(*[F.when(F.col("_set"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def with_event(df: DataFrame, events: DataFrame, key: str, order: list[Column], column: str) -> DataFrame:
    """``column`` of each row as its last event says; rows without an event keep theirs."""
    last = latest(events, key, order).select(key, F.col(column).alias("_new"))
    return df.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str], list[str]]]) -> DataFrame:
    """Parents with each child table's rows as a sorted list: (table, foreign key, order columns, other columns)."""
    out = parents
    for name, (child, foreign, order, columns) in children.items():
        rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
        out = out.join(child.groupBy(F.col(foreign).alias(key)).agg(rows.alias(name)), key, "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def looked_up(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for the ordered keys of ``wanted`` (``pos`` and the key), with ``lookup_status`` found or missing."""
    there = table.withColumn("_there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("lookup_status", F.when(F.col("_there"), "found").otherwise("missing")).drop("_there")


def first_match(rows: DataFrame, lookup: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    """``value`` of the first row of ``lookup`` with all the keys (null where there is none)."""
    best = lookup.groupBy(*keys).agg(F.min_by(value, order).alias(value))
    return rows.join(best, keys, "left")


def only_match(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of ``lookup`` where the keys name exactly one, else null."""
    single = lookup.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_other")).filter(F.col(value) == F.col("_other")).drop("_other")
    return rows.join(single, keys, "left")


def with_images(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """``before`` and ``after`` of the columns as structs, and whether they differ."""
    names = list(changed)
    before, after = F.struct(*names), F.struct(*[changed[n].alias(n) for n in names])
    return df.withColumn("before", before).withColumn("after", after).withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def partitioned(df: DataFrame, passes: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and all others; a null does not pass."""
    holds = F.coalesce(passes, F.lit(False))
    return df.filter(holds), df.filter(~holds)
