"""Caches, services and their bookkeeping as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KEY = ["engine", "params", "text"]


def latest(cache: DataFrame, key: list[str] | None = None, id: str = "id") -> DataFrame:
    """One row of each key, the one of highest id: what a unique key with replacement keeps."""
    rest = [c for c in cache.columns if c not in (key or KEY)]
    return cache.groupBy(*(key or KEY)).agg(F.max_by(F.struct(*rest), id).alias("_r")).select(*(key or KEY), "_r.*").select(*cache.columns)


def upserted(cache: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """cache with rows (no ids) put in, later ones of a key winning. `order`, a column of rows, is their number from 1 on in the
    order in which they came; ids go on by it from the cache's highest, so that a recomputed partition gives the same ids."""
    top = cache.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = rows.join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col(order).cast("long"))
    return latest(cache.unionByName(new.select(*cache.columns)))


def newest(cache: DataFrame, n: int = 50_000, id: str = "id") -> DataFrame:
    top = cache.agg(F.max(id).alias("_top"))  # one row
    return cache.join(F.broadcast(top), F.col(id) > F.col("_top") - n).drop("_top")


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with the cached translation, null where there is none."""
    return requests.join(latest(cache).select(*KEY, "translation"), KEY, "left")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, KEY, "left_anti").distinct()


def answered(requests: DataFrame, client: Callable[[], Callable[[str], str]], qps: float, text: str = "text", out: str = "translation") -> DataFrame:
    """requests with a client's answers, at `qps` over all partitions; a client is made once a partition."""
    parts = max(1, requests.rdd.getNumPartitions())
    schema = StructType([*requests.schema.fields, StructField(out, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask, pause, due = client(), parts / qps, 0.0
        for f in frames:
            got = []
            for t in f[text]:
                now = time.monotonic()
                if now < due:
                    time.sleep(due - now)
                due = max(now, due) + pause
                got.append(ask(t))
            yield f.assign(**{out: got})

    return requests.mapInPandas(run, schema)


def rows_by_engine(cache: DataFrame) -> DataFrame:
    return cache.groupBy("engine").agg(F.count("*").alias("n"))


def improved(before: Column, after: Column) -> Column:
    """No field (of two arrays of numbers) is greater and one is less; null fields are no improvement."""
    pairs = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    bad = F.exists(pairs, lambda p: p["b"].isNull() | p["a"].isNull() | (p["a"] > p["b"]))
    return ~bad & F.exists(pairs, lambda p: p["a"] < p["b"])


def windows_at(tail: Column, head: Column, n: int) -> Column:
    return F.struct(F.right(tail, F.lit(n)).alias("before"), F.left(head, F.lit(n)).alias("after"))


def planned_chains(members: DataFrame, most_tokens: int) -> DataFrame:
    """A plan for each chain (chain_id, chain_index, text, tokens): claimed, or refused with the reason."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain_index", "text"))), lambda m: m["text"]), "\n")
    c = members.groupBy("chain_id").agg(F.count("*").alias("members"), F.sum("tokens").alias("tokens"), F.bool_or(F.col("text").isNull() | (F.trim("text") == "")).alias("_blank"), text.alias("text"))
    why = F.when(F.col("members") < 2, "single").when(F.col("_blank"), "blank_member").when(F.col("tokens") > most_tokens, "too_long")
    return c.withColumn("refusal", why).drop("_blank")


def repaired(rows: DataFrame, detect: Callable[[DataFrame], DataFrame], act: Callable[[DataFrame, DataFrame], DataFrame], save: Callable[[DataFrame, int], DataFrame], most: int = 3) -> tuple[DataFrame, list[dict[str, int]]]:
    """Detects, acts and looks again until nothing is found or nothing gets better; a round that doesn't help is undone.

    save(df, round) writes a round's rows where all executors can read them. Issues need a column `kind`.
    """
    count = lambda i: {r.kind: r["count"] for r in i.groupBy("kind").count().collect()}  # noqa: E731  a row a kind
    issues = detect(rows)
    history = [count(issues)]
    for k in range(most):
        if not history[-1]:
            break
        after = save(act(rows, issues), k)
        found = detect(after)
        now = count(found)
        if sum(now.values()) >= sum(history[-1].values()) or any(n > history[-1].get(kind, 0) for kind, n in now.items()):
            break
        rows, issues = after, found
        history.append(now)
    return rows, history


def in_declared_order(issues: DataFrame, order: list[str]) -> DataFrame:
    return issues.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col("kind")), "id")


def page_chunks(total: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, total) - 1) for a in range(0, total, size)]


def replayed(log: DataFrame, execution: str, after: int) -> DataFrame:
    """Events behind a cursor; an error where some of them are gone already."""
    own = log.where((F.col("execution_id") == execution) & (F.col("sequence") > after))
    low = F.min("sequence").over(Window.partitionBy("execution_id"))
    gap = F.assert_true(F.col("_low") <= after + 1, F.lit("events after the cursor were evicted"))
    return own.withColumn("_low", low).where(gap.isNull()).drop("_low").orderBy("sequence")
