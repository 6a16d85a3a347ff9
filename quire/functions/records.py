"""JSON replies and settings, canonical forms and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_pairs(reply: Column) -> Column:
    """array<struct<src, tgt>> of a JSON list; entries without both, or of 100 characters and more, are left out."""
    got = F.from_json(reply, "array<struct<src: string, tgt: string>>")
    cut = F.transform(got, lambda t: F.struct(F.trim(t["src"]).alias("src"), F.trim(t["tgt"]).alias("tgt")))
    fits = lambda c: F.length(c).between(1, 99)
    return F.coalesce(F.filter(cut, lambda t: fits(t["src"]) & fits(t["tgt"])), F.array().cast("array<struct<src: string, tgt: string>>"))


def strict_reply(reply: Column, fields: dict[str, str], bounds: dict[str, tuple[float, float]] | None = None, words: dict[str, list[str]] | None = None) -> Column:
    """struct<value, violation>: a JSON object that has exactly these fields, numbers in bounds and words of a vocabulary;
    the first rule that it breaks otherwise."""
    value = F.from_json(reply, ", ".join(f"{k} {t}" for k, t in fields.items()))
    keys = F.json_object_keys(reply)
    why = F.when(keys.isNull(), "not_json")
    for k in fields:
        why = why.when(~F.array_contains(keys, k), f"missing:{k}")
    why = why.when(F.size(keys) > len(fields), "extra_field")
    for k in fields:
        why = why.when(value[k].isNull(), f"type:{k}")
    for k, (lo, hi) in (bounds or {}).items():
        why = why.when(~value[k].between(lo, hi), f"bounds:{k}")
    for k, allowed in (words or {}).items():
        why = why.when(~value[k].isin(allowed), f"vocabulary:{k}")
    return F.struct(F.when(why.isNull(), value).alias("value"), why.alias("violation"))


def canonical_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def cache_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def without_fields(m: Column, names: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(names))


def short_id(*key: Column, length: int = 5) -> Column:
    """The same id for the same key, instead of a random one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *key), 256), 1, length)


def range_faults(settings: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, fault) of settings (name, value: string) that lack `<name>_allowed_range` ("lo..hi") or lie outside it."""
    ranges = settings.where(F.col(name).endswith("_allowed_range")).select(F.regexp_replace(name, "_allowed_range$", "").alias("_k"), F.split(value, r"\.\.").alias("_r"))
    own = settings.where(~F.col(name).endswith("_allowed_range")).join(ranges, F.col(name) == F.col("_k"), "left")
    v, lo, hi = (x.try_cast("double") for x in (F.col(value), F.col("_r")[0], F.col("_r")[1]))
    fault = F.when(F.col("_r").isNull(), "no_range").when(v.isNull() | lo.isNull() | hi.isNull(), "not_a_number").when((v < lo) | (v > hi), "out_of_range")
    return own.select(name, fault.alias("fault")).where("fault is not null")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile scan."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def record(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)))
