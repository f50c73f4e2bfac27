"""Problem 1: groups of records whose words agree, after small edits, insertions or reordering.

Method: multiple global orders. Every token (a word and its number of occurrence) has a rank under each of many global
orders; records that agree share the head of their token prefix under an order with the probability of their similarity.
A filter intersects several orders: a candidate pair must share the heads under all of them, and one of ``filters`` such
intersections must hold. With 5 orders a filter and 56 filters a pair at similarity 0.7 is missed with probability
3e-5, one at 0.75 with 3e-7, while unrelated records (0.05) meet with 2e-5. A bitmap bound, which never rejects a true
pair, then thins the candidates, and exact multiset similarity verifies them.

Records with the same words are one class with one representative, so a group of copies, however large, costs one row a
class until the pairs of all members are written out at the end.

Every join has a side that grows with the table, and the planner takes arrays of tokens for one token each, so it would
send such a side through the driver; all of them ask for a shuffled join (``merge``).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import cut_lineage

WORD = re.compile(r"\w+")
SIGNATURE_BITS = 128

FEATURES = T.StructType(
    [
        T.StructField("class", T.BinaryType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def tokens_of(text: str, known: dict[tuple[str, int], int]) -> np.ndarray:
    """A sorted 64-bit hash for each occurrence of each word."""
    out = []
    for word, n in Counter(WORD.findall(text.lower())).items():
        for i in range(n):
            h = known.get((word, i))
            if h is None:
                if len(known) > 1 << 20:
                    known.clear()
                h = known[word, i] = xxhash.xxh3_64_intdigest(f"{i} {word}".encode("utf-8", "surrogatepass"))
            out.append(h)
    return np.sort(np.array(out, np.uint64))


def order_parameters(orders: int) -> np.ndarray:
    return np.random.default_rng(20240101).integers(1, 1 << 63, (2, orders), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def filter_keys(tokens: np.ndarray, filters: int, orders_each: int) -> np.ndarray:
    """One key a filter: the hash of the first tokens under its orders."""
    scale, shift = order_parameters(filters * orders_each)
    with np.errstate(over="ignore"):
        ranks = mixed(tokens[:, None] * scale[None, :] + shift[None, :])
        heads = tokens[ranks.argmin(axis=0)].reshape(filters, orders_each)
        key = np.arange(1, filters + 1, dtype=np.uint64)
        for i in range(orders_each):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + heads[:, i])
    return key.astype(np.int64)


def features_udf(least_words: int, filters: int, orders_each: int):
    known: dict[tuple[str, int], int] = {}

    @F.pandas_udf(FEATURES)
    def features(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            tokens = tokens_of(text, known)
            if len(tokens) < max(1, least_words):
                rows.append((None, len(tokens), None, None, None, None))
                continue
            bits = np.bincount((tokens % np.uint64(SIGNATURE_BITS)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
            low, high = np.packbits(bits.astype(np.uint8)).view(np.int64)
            rows.append((xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), low, high, tokens.view(np.int64), filter_keys(tokens, filters, orders_each)))
        return pd.DataFrame(rows, columns=[f.name for f in FEATURES])

    # Declared nondeterministic, so that the filter on its result does not make the planner evaluate it a second time.
    return features.asNondeterministic()


def joined_text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def similar_classes(classes: DataFrame, least: float) -> DataFrame:
    """(class_a, class_b, similarity) of different classes that agree to at least ``least``."""
    heads = classes.select("class", "size", "low", "high", F.explode("keys").alias("key"))
    a = heads.select("key", *[F.col(c).alias(f"{c}_a") for c in ("class", "size", "low", "high")])
    b = heads.select("key", *[F.col(c).alias(f"{c}_b") for c in ("class", "size", "low", "high")])
    apart = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    both = F.col("size_a") + F.col("size_b")
    bound = apart <= both * ((1 - least) / (1 + least)) + 1e-6
    sizes = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-6
    pairs = a.join(b.hint("merge"), "key").filter((F.col("class_a") < F.col("class_b")) & sizes & bound).select("class_a", "class_b").distinct()
    words = classes.select("class", "tokens").hint("merge")
    full = pairs.join(words.select(F.col("class").alias("class_a"), F.col("tokens").alias("tokens_a")), "class_a").join(
        words.select(F.col("class").alias("class_b"), F.col("tokens").alias("tokens_b")), "class_b"
    )
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    ratio = shared / (F.size("tokens_a") + F.size("tokens_b") - shared)
    return full.select("class_a", "class_b", ratio.alias("similarity")).filter(F.col("similarity") >= least - 1e-9)


def near_duplicates(
    df: DataFrame, id_column: str, text_columns: list[str], least: float = 0.7, least_words: int = 40, filters: int = 56, orders_each: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Members (id, class, representative) and links (id_a, id_b, similarity) between class representatives.

    Words are runs of letters, digits and underscores in lower case, counted with repetition; null fields count as empty.
    Records with fewer than ``least_words`` words (or none) take no part. Repeated rows of an id count once. The
    representative of a class is its smallest id. Other columns are ignored; an empty table gives empty results.
    """
    rows = df.select(F.col(id_column).alias("id"), joined_text(text_columns).alias("_text")).filter(F.col("id").isNotNull())
    made = rows.select("id", features_udf(least_words, filters, orders_each)("_text").alias("f")).select("id", "f.*").filter(F.col("class").isNotNull())
    made = cut_lineage(made)
    members = made.select("id", "class").distinct()
    first = members.groupBy("class").agg(F.min("id").alias("representative")).hint("merge")
    classes = made.groupBy("class").agg(*[F.first(c).alias(c) for c in ("size", "low", "high", "tokens", "keys")])
    links = similar_classes(classes, least)
    named = links.join(first.select(F.col("class").alias("class_a"), F.col("representative").alias("a")), "class_a").join(
        first.select(F.col("class").alias("class_b"), F.col("representative").alias("b")), "class_b"
    )
    return members.join(first, "class").select("id", "class", "representative"), named.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")


def expanded_links(members: DataFrame, links: DataFrame, part: int = 1_000) -> DataFrame:
    """(id_a, id_b) of every two records that agree: all pairs within a class and between the members of linked classes.

    The result grows with the product of the class sizes, as the pairs do; ``near_duplicates`` itself is the form that
    stays linear. A class of more than ``part`` members is met in parts of about that size, so that no task has all its
    pairs.
    """
    sizes = members.groupBy("representative").agg(F.count("*").alias("n"), F.ceil(F.count("*") / part).cast("int").alias("parts")).hint("merge")
    own = sizes.filter("n > 1").select(F.col("representative").alias("id_a"), F.col("representative").alias("id_b"))
    met = links.select("id_a", "id_b").unionByName(own).join(sizes.select(F.col("representative").alias("id_b"), "parts"), "id_b")
    left = members.select("id", F.col("representative").alias("id_a")).join(met.hint("merge"), "id_a")
    left = left.select("id", "id_b", (F.col("id_a") == F.col("id_b")).alias("own"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    right = members.join(sizes, "representative").select(F.col("id").alias("other"), F.col("representative").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right.hint("merge"), ["id_b", "part"]).filter((F.col("id") < F.col("other")) | ~F.col("own") & (F.col("id") > F.col("other")))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
