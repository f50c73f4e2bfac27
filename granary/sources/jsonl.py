"""Line JSON and document sources and sinks with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a broken or non-object line ends the job and is named with its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": "_broken"}))
    sound = F.col("_row").isNotNull() & F.col("_row._broken").isNull() & F.trim("value").startswith("{")
    checked = parsed.withColumn("_row", F.when(sound, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("broken line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 120)))))
    return checked.select(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, line_number, value) of every line, numbered from 1 within its file, however the file is split.

    A split's lines get their numbers from the lines of the splits before it; only (file, split, count) is aggregated.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = lines.groupBy("source_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.withColumn("_before", before).select("source_path", "_block", "_first", "_before")
    return lines.join(placed, ["source_path", "_block"]).select("source_path", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_number"), "value")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Broken lines become rows with ``parse_error``, ``source_path`` and ``line_number``; good ones have the error null."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.withColumn("_row", F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("_row").isNull() | F.col("_row._broken").isNotNull() | ~F.trim("value").startswith("{")
    fields = [F.when(~broken, F.col("_row")[f.name]).alias(f.name) for f in schema.fields]
    return rows.select(*fields, F.when(broken, F.col("value")).alias("parse_error"), "source_path", "line_number")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at the path or pattern, on whatever file system it names."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty relation where nothing lies at ``path``."""
    return read_strict(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The one JSON document at ``path`` as a row; without a file a row of nulls, as of an empty object."""
    if path_exists(spark, path):
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_array(spark: SparkSession, path: str, row: T.StructType, key: str = "rows") -> DataFrame:
    """The rows of a document that is a list, or holds one under ``key``, with ``pos`` from 0 within their file."""
    text = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    held = F.coalesce(F.get_json_object("value", f"$.{key}"), F.col("value"))
    rows = text.select("source_path", F.posexplode(F.from_json(held, T.ArrayType(row))).alias("pos", "row"))
    return rows.select("source_path", "pos", *[F.col("row")[f.name].alias(f.name) for f in row.fields])


def objects_within(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, path, object) of every object anywhere in the JSON text, the whole and those within others too.

    Arbitrary depth has no built-in, so each batch is walked in Python; broken text gives no row.
    """

    @F.pandas_udf("array<struct<path:string,object:string>>")
    def walked(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else found_objects(v))

    rows = df.select(*keep, F.explode(walked(column)).alias("o"))
    return rows.select(*keep, "o.path", "o.object")


def found_objects(text: str) -> list[tuple[str, str]]:
    try:
        held = [("$", json.loads(text))]
    except ValueError:
        return []
    out = []
    while held:
        path, value = held.pop()
        if isinstance(value, dict):
            out.append((path, json.dumps(value, ensure_ascii=False, sort_keys=True)))
            held += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            held += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
    return out


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(path, suffix, text, record) of text files; bytes that are no UTF-8 are dropped, a form feed begins a new record."""
    files = read_files(spark, path).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("suffix").isin(*suffixes))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select("path", "suffix", F.posexplode(F.split(text, "\f")).alias("record", "text"))


def dispatched(spark: SparkSession, path: str, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """All files below ``path`` by the reader of their suffix, together; files of other suffixes are left out."""
    files = read_files(spark, path).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    out = None
    for suffix, reader in readers.items():
        own = reader(files.filter(F.col("suffix") == suffix))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and bytes of the files below ``path``, hidden ones and README.md left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.startswith(".") & (F.lower(name) != "readme.md")).select("path", "length", "content")


def listed_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(name, path, length) of the files, in path order; the contents are not read."""
    files = read_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (files.filter(suffix.isin(*suffixes)) if suffixes else files).orderBy("path")


def union_first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """All frames together; of a repeated key the row of the earliest frame (a later one: pass them reversed)."""
    from granary.operators.sequences import first_per_key

    rows = None
    for i, frame in enumerate(frames):
        own = frame.withColumn("_source", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return first_per_key(rows, [key], [F.asc("_source"), *[F.asc_nulls_first(c) for c, t in rows.dtypes if c not in (key, "_source") and not t.startswith("map")]]).drop("_source")


def union_counted(frames: list[DataFrame], key: str, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """The union in which the first (or last) source of a key wins, and (key, duplicates) of the keys met again."""
    ordered = list(reversed(frames)) if last else frames
    every = None
    for frame in frames:
        every = frame.select(key) if every is None else every.unionByName(frame.select(key))
    again = every.groupBy(key).agg((F.count("*") - 1).alias("duplicates")).filter("duplicates > 0")
    return union_first_wins(ordered, key), again


def union_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Partitions such as pass, revise, reject and error together, each row with the name of its own."""
    out = None
    for name, part in parts.items():
        own = part.withColumn(label, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in this order, missing values empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", "true").csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_report(df: DataFrame, most: int = 10_000) -> str:
    """Rows of a small result as JSON text, keys sorted and indented; more than ``most`` rows raise an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, sort_keys=True, default=str)


def markdown_report(df: DataFrame, title: str, most: int = 1_000) -> str:
    """A small result as a titled table; more than ``most`` rows raise an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cells = [df.columns, ["---"] * len(df.columns), *[["" if v is None else " ".join(str(v).split()).replace("|", "\\|") for v in r] for r in rows]]
    return "\n".join([f"# {title}", "", *("| " + " | ".join(c) + " |" for c in cells), ""])


def pages_dump(df: DataFrame, source: str, page: str, text: str) -> DataFrame:
    """(source, markdown): the pages of each source in order under headings, one document a source."""
    pages = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    shown = F.transform(pages, lambda x: F.concat(F.lit("## "), x["p"].cast("string"), F.lit("\n\n"), x["t"]))
    return df.groupBy(source).agg(F.concat(F.lit("# "), F.first(source), F.lit("\n\n"), F.array_join(shown, "\n\n")).alias("markdown"))
