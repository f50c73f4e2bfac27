"""Stored indexes: texts with their postings, vectors with their places, and checks that they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.retrieval import postings, scores, small
from granary.operators.sequences import numbered


def build_text_index(df: DataFrame, path: str, key: str, fields: dict[str, float], overwrite: bool = False, buckets: int = 64) -> None:
    """Write ``rows`` (with ``doc_id`` from 1 in key order), ``postings`` by term bucket, and ``lengths`` under ``path``.

    An index that is there ends the job unless ``overwrite``. A search reads only the buckets of its terms.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    numbered(df.dropDuplicates([key]), [F.asc(key)], "doc_id").write.mode(mode).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    made = postings(rows, "doc_id", fields).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    made.repartition("bucket", F.pmod("id", F.lit(16))).sortWithinPartitions("term").write.mode(mode).partitionBy("bucket").parquet(f"{path}/postings")
    length = None
    for c in fields:
        own = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[0-9a-z가-힣]+"), F.lit(0)))
        length = own if length is None else length + own
    rows.agg(F.count("*").alias("docs"), F.avg(length).alias("mean")).write.mode(mode).parquet(f"{path}/lengths")


def search_text_index(spark: SparkSession, path: str, queries: DataFrame, buckets: int = 64) -> DataFrame:
    """(query, id, score) from a stored index; ``queries`` has ``query`` and ``term``."""
    wanted = queries.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
    hits = spark.read.parquet(f"{path}/postings").join(small(wanted), ["bucket", "term"]).select("id", "term", "f", "length")
    return scores(hits, spark.read.parquet(f"{path}/lengths"), queries)


def build_vector_index(df: DataFrame, path: str, id_column: str, vector_column: str, overwrite: bool = False) -> None:
    """Write the vectors with ``embedding_index`` from 0 in id order; a row without id gets one from its place."""
    rows = numbered(df, [F.asc_nulls_last(id_column)], "_n").withColumn("embedding_index", F.col("_n") - 1).drop("_n")
    named = F.coalesce(F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")), F.format_string("embedding_row_%08d", F.col("embedding_index")))
    rows.withColumn("row_id", named).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_vector_index(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored vectors, or an empty relation where no index lies: a search then finds nothing."""
    from granary.sources.jsonl import path_exists

    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): rows by each value of each column, counted in one pass."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    out = df.select(*named).groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    name, value = F, F
    for c in columns:
        name, value = name.when(F.col("_g") == bits[c], F.lit(c)), value.when(F.col("_g") == bits[c], F.col(c))
    return out.select(name.alias("column"), value.alias("value"), "n")


def integrity(rows: DataFrame, key: str, policy: dict[str, object], path_column: str) -> DataFrame:
    """One row: rows, distinct keys, rows against each fixed policy value, rows without a path."""
    wrong = None
    for name, value in policy.items():
        own = ~F.col(name).eqNullSafe(F.lit(value))
        wrong = own if wrong is None else wrong | own
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.lit(False) if wrong is None else wrong).alias("policy_mismatches"),
        F.count_if(F.coalesce(F.trim(path_column) == "", F.lit(True))).alias("missing_paths"),
    )
