"""Text and vector retrieval as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def index_terms(text: Column) -> Column:
    """Lower-case runs of digits, Latin and Hangul, as a text index holds them (numbers too)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]+"), F.lit(0))


def weighted_terms(column: str, weight: float) -> Column:
    """The terms of a field as (term, w) entries."""
    return F.transform(index_terms(F.coalesce(F.col(column), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def postings(df: DataFrame, id_column: str, fields: dict[str, float]) -> DataFrame:
    """(id, term, weighted frequency, length) of every term of every document; length counts the terms of all fields."""
    rows = df.select(F.col(id_column).alias("id"), F.concat(*[weighted_terms(c, w) for c, w in fields.items()]).alias("terms"))
    rows = rows.select("id", F.size("terms").alias("length"), F.explode("terms").alias("t"))
    return rows.groupBy("id", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("f"), F.first("length").alias("length"))


def bm25(df: DataFrame, id_column: str, fields: dict[str, float], queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score) for documents that share a term with a query; less is better, as the scores are negated.

    ``queries`` has ``query`` and ``term``. Length statistics are of all documents, each id once however often it is
    delivered. Only the queries' terms are kept before anything is shuffled, and a term's rarity is counted on those rows.
    """
    made = [weighted_terms(c, w) for c, w in fields.items()]
    rows = df.select(F.col(id_column).alias("id"), F.concat(*made).alias("terms")).select("id", F.size("terms").alias("length"), "terms")
    whole = rows.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    wanted = small(queries.select("term").distinct())
    each = rows.withColumn("copy", F.monotonically_increasing_id()).select("id", "length", "copy", F.explode("terms").alias("t")).select("id", "length", "copy", "t.term", "t.w")
    hits = each.join(wanted, "term").groupBy("id", "length", "copy", "term").agg(F.sum("w").alias("f"))
    hits = hits.groupBy("id", "term").agg(F.first("length").alias("length"), F.first("f").alias("f"))
    return scores(hits, whole, queries, k1, b)


def scores(hits: DataFrame, whole: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score) from the queries' postings ``hits`` (id, term, f, length) and the collection's ``docs`` and ``mean``."""
    rarity = hits.groupBy("term").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rarity = rarity.select("term", "mean", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"))
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    asked = queries.select("query", "term").distinct()
    return hits.join(asked.join(rarity, "term"), "term").groupBy("query", "id").agg((-F.sum(part)).alias("score"))


def top(df: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition in order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int, other: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` most alike vectors of each query vector. A stated query set meets all rows.

    Lengths are measured once a vector. Queries of up to ``BROADCAST_ROWS`` travel to the vectors; more meet them in
    blocks of about that many, each block's best ``k`` kept before they are merged.
    """
    size = F.sqrt(dot(F.col(vector_column), F.col(vector_column)))
    q = queries.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("_q"), size.alias("_qn"))
    v = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("_v"), size.alias("_vn"))
    many = q.count()
    blocks = max(1, -(-many // BROADCAST_ROWS))
    found = None
    for block in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scored = v.join(F.broadcast(own), (F.col("id") != F.col("query_id")) if other else F.lit(True))
        score = F.round(dot(F.col("_q"), F.col("_v")) / (F.col("_qn") * F.col("_vn")), 6)
        ranked = top(scored.select("query_id", "id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def level_of(row: list[Column], wanted: list[Column]) -> Column:
    """How far a row is in scope: 0 if all levels agree, up to the number of levels if not even the first does.

    Levels go from the widest in; a wanted level that is null or blank agrees with anything, and a level within only
    counts where those around it agree.
    """
    agree = [F.coalesce(F.trim(w) == "", F.lit(True)) | F.coalesce(F.trim(r) == F.trim(w), F.lit(False)) for r, w in zip(row, wanted)]
    out = F.lit(len(agree))
    held = F.lit(True)
    for depth, same in enumerate(agree):
        held = held & same
        out = F.when(held, len(agree) - depth - 1).otherwise(out)
    return out


def progressive(scored: DataFrame, query: str, id_column: str, level: str, score: str, k: int) -> DataFrame:
    """The first ``k`` rows of each query by level, then score, then id: nested levels, so none is met twice."""
    return top(scored, [query], [F.asc(level), F.desc(score), F.asc(id_column)], k)
