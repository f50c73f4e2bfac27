"""Ids, hashes, numbers and JSON values as Column expressions."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(*parts: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by ``::``."""
    return F.substring(F.sha2(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def hash_modulo(x: Column, n: int) -> Column:
    """The first 16 hex digits of the SHA-256 as a number, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def none_if_blank(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def int_or(x: Column, default: int) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def scope_key(*parts: Column) -> Column:
    """Compacted names joined by ``|``: the key by which taxonomy rows are compared."""
    from granary.functions.text import compact_key

    return F.concat_ws("|", *[F.coalesce(compact_key(p), F.lit("")) for p in parts])


def string_list(x: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def json_from_text(x: Column) -> Column:
    """The outermost braces of a model's reply, fences and talk around them dropped."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def answer_number(x: Column) -> Column:
    """1..5 from a number or a letter A..E; else null."""
    text = F.upper(F.trim(x.cast("string")))
    return F.when(text.rlike("^[1-5]$"), text.cast("int")).when(text.rlike("^[A-E]$"), F.ascii(text) - 64)


def shuffled(seed: str, count: int) -> list[int]:
    """Display order of ``count`` options: the generator seeded with the leading 64 bits of the seed's SHA-256."""
    order = list(range(count))
    random.Random(int(hashlib.sha256(seed.encode()).hexdigest()[:16], 16)).shuffle(order)
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def display_order(session: pd.Series, item: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([shuffled(f"{s}|{i}", int(n)) for s, i, n in zip(session, item, count)])


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object of strings and numbers as text, keys sorted, ``", "`` and ``": "`` between them; nulls stay as null."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        shown = F.to_json(F.array(value))
        parts.append(F.concat(F.lit(f'"{name}": '), F.substring(shown, F.lit(2), F.length(shown) - 2)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def payload_id(prefix: str, fields: dict[str, Column], length: int = 16) -> Column:
    """Prefix and leading hex digits of the SHA-256 of the canonical object."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(fields), 256), 1, length))


def slug_id(prefix: str, *parts: Column) -> Column:
    """Prefix and ten hex digits of the SHA-1 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 10))


def id_or_hash(own: Column, *parts: Column, prefix: str = "scope-") -> Column:
    """The id where there is one, else one from the hash of the parts."""
    return F.coalesce(none_if_blank(own), F.concat(F.lit(prefix), stable_id(*parts, length=12)))


def capped(count: Column, each: float, most: float) -> Column:
    return F.least(F.lit(most), count * F.lit(each))


def stands_out(options: Column, answer: Column, times: float = 1.8, least: int = 28) -> Column:
    """Whether the answer (from 1) is longer than ``least`` and ``times`` the mean of the other options."""
    sizes = F.transform(options, lambda o: F.length(F.coalesce(o, F.lit(""))).cast("double"))
    own = F.when(answer >= 1, F.try_element_at(sizes, F.greatest(answer.cast("int"), F.lit(1))))
    others = F.size(sizes) - 1
    rest = F.aggregate(sizes, F.lit(0.0), lambda s, v: s + v) - own
    return F.coalesce((own > least) & (others > 0) & (own * others > rest * times), F.lit(False))


def unit_vector(x: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(x, lambda v: F.when(size > 0, v / size).otherwise(F.lit(0.0)))


def boosted(score: Column, text: Column, terms: Column, each: float = 0.05, most: float = 0.12) -> Column:
    """The score raised by every term that stands in the text, up to a limit."""
    return score + capped(F.size(F.filter(terms, lambda t: F.contains(text, t))), each, most)


def json_or(x: Column, schema: str, default: Column) -> Column:
    """The parsed value, or the default for null, blank and broken text."""
    return F.coalesce(F.from_json(none_if_blank(x), schema), default)


def option_list(x: Column) -> Column:
    """Options of a JSON list or object (by sorted key), each a string or an object with ``text`` or ``content``."""
    held = F.from_json(x, "array<string>")
    keyed = F.from_json(x, "map<string,string>")
    by_key = F.transform(F.array_sort(F.map_keys(keyed)), lambda k: F.element_at(keyed, k))
    raw = F.coalesce(held, by_key, F.array().cast("array<string>"))
    return F.transform(raw, lambda o: F.coalesce(F.get_json_object(o, "$.text"), F.get_json_object(o, "$.content"), o))


def option_at(options: Column, index: Column) -> Column:
    """The option at a place from 1, empty beyond the list."""
    return F.coalesce(F.when(index >= 1, F.try_element_at(options, F.greatest(index.cast("int"), F.lit(1)))), F.lit(""))


def answer_count(x: Column, options: Column) -> Column:
    """How many answers a JSON value names: entries of a list or object, parts between commas, or a place among the options."""
    text = F.trim(x)
    bare = F.regexp_replace(text, '^"|"$', "")
    parts = F.size(F.filter(F.split(bare, ","), lambda p: F.trim(p) != ""))
    return (
        F.when(text.isNull() | (text == "") | (text == "null") | (bare == ""), 0)
        .when(text.startswith("["), F.size(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))))
        .when(text.startswith("{"), F.size(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))))
        .when(text.rlike("^-?[0-9]+$"), F.when(text.cast("decimal(38,0)").between(F.lit(1), F.size(options)), 1).otherwise(0))
        .when(F.contains(bare, F.lit(",")), parts)
        .otherwise(1)
    )


def merged_ids(*lists: Column) -> Column:
    """Ids of all lists, each once, in order; blanks and nulls left out."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda i: F.trim(i) != ""))


CHECK = "struct<verdict:string,reason:string>"


def normalized_verdict(x: Column, valid: tuple[str, ...], checks: tuple[str, ...], fallback: str, missing: str, unexplained: str) -> Column:
    """A model's verdict as (verdict, revision_required, checks, errors).

    Verdicts that are not valid become ``fallback``, absent checks are added with the reason ``missing``, blank reasons
    become ``unexplained``, and each repair is listed under ``errors``. Broken text counts as an empty object.
    """
    held = F.from_json(x, f"struct<overall_verdict:string,revision_required:boolean,checks:map<string,{CHECK}>,notes:string>")
    own = held["overall_verdict"]
    sound = F.coalesce(own.isin(*valid), F.lit(False))
    verdict = F.when(sound, own).otherwise(fallback)
    errors = [F.when(~sound, F.concat(F.lit("invalid overall_verdict: "), F.coalesce(own, F.lit("None")))), F.when(held["checks"].isNull(), F.lit("checks is missing or not an object"))]
    entries = []
    for name in checks:
        check = F.try_element_at(held["checks"], F.lit(name))
        known, said = F.coalesce(check["verdict"].isin(*valid), F.lit(False)), F.coalesce(F.trim(check["reason"]) != "", F.lit(False))
        fixed = F.struct(F.when(known, check["verdict"]).otherwise(fallback).alias("verdict"), F.when(check.isNull(), missing).when(said, check["reason"]).otherwise(unexplained).alias("reason"))
        entries.append(F.struct(F.lit(name).alias("key"), fixed.alias("value")))
        errors += [F.when(check.isNull(), f"missing check: {name}"), F.when(check.isNotNull() & ~known, f"invalid check verdict: {name}"), F.when(check.isNotNull() & ~said, f"missing check reason: {name}")]
    errors.append(F.when(held["notes"].isNull(), "notes is missing or not a string"))
    required = F.coalesce(held["revision_required"], F.lit(False)) | verdict.isin("revise", "reject")
    return F.struct(verdict.alias("verdict"), required.alias("revision_required"), F.map_from_entries(F.array(*entries)).alias("checks"), F.array_compact(F.array(*errors)).alias("errors"))


def failed_checks(checks: Column, failing: tuple[str, ...] = ("revise", "reject")) -> Column:
    """Names of the checks with a failing verdict, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(checks, lambda _, c: c["verdict"].isin(*failing))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def relocated(options: pd.Series, answer: pd.Series, target: pd.Series, seed: pd.Series) -> pd.Series:
    """Options with the answer moved to the target place; the others follow in an order drawn from the seed."""
    out = []
    for own, a, t, s in zip(options, answer, target, seed):
        if own is None or a is None or t is None or not (1 <= a <= len(own) and 1 <= t <= len(own)):
            out.append(None if own is None else list(own))
            continue
        rest = [o for i, o in enumerate(own, 1) if i != a]
        rest = [rest[i] for i in shuffled(str(s), len(rest))]
        out.append([*rest[: int(t) - 1], own[int(a) - 1], *rest[int(t) - 1 :]])
    return pd.Series(out, dtype=object)


def first_hint(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """The value of the first alias that the text contains, else null."""
    out = F
    for alias, value in aliases:
        out = out.when(F.contains(text, F.lit(alias)), F.lit(value))
    return out.otherwise(F.lit(None).cast("string"))


def entries_of(x: Column, key: str = "questions") -> Column:
    """The objects of a JSON list, of the list under ``key``, or the one object itself, each as text."""
    kind = F.substring(F.trim(x), 1, 1)
    wrapped, listed = F.from_json(F.get_json_object(x, f"$.{key}"), "array<string>"), F.from_json(F.when(kind == "[", x), "array<string>")
    single = F.when((kind == "{") & F.from_json(x, "map<string,string>").isNotNull(), F.array(x))
    return F.coalesce(wrapped, listed, single, F.array().cast("array<string>"))


def merged_defaults(x: Column, defaults: dict[str, str]) -> Column:
    """A JSON object's text fields, each with its default where it is absent or blank, as a struct."""
    return F.struct(*[F.coalesce(none_if_blank(F.get_json_object(x, f"$.{name}")), F.lit(value)).alias(name) for name, value in defaults.items()])
