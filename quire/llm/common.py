"""What the operators of this subpackage share: written tables, links to classes, names that don't clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which an execution's shuffle files go when it ends: a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one if all tasks run on this machine
    in the driver's process, else an error: an executor's own disk is not seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; sweep() deletes it."""
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this application has written, the last ones behind unread results among them."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_quire_path", None)
        if path:
            _delete(t.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot from so many rows on, or from this share of all rows, so that MOST_HOT keys are hot at most.
LEAST_HOT, MOST_HOT = 256, 10_000


def looked_up(rows: DataFrame, groups: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """`rows` joined to `groups`, which has one row a key and the number of rows of that key in its column n.

    Keys that many rows hold would all go to one task: they are broadcast instead, MOST_HOT of them at most, as each holds
    more than one in MOST_HOT of `total` rows. Both tables are read twice where there is such a key, so pass written ones.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = groups.where(F.col("n") > limit)
    if not hot.limit(1).count():
        return rows.join(groups, key)
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(groups.where(F.col("n") <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Rows of 64 bits that told() broadcasts, at most; of so many keys that they fill these, more are looked up than need be.
MOST_BITS = 1 << 20


def told(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` with one more column, `_may`: false where `key` is surely none of `keys`, so that most rows need no shuffle
    to be looked up. `keys` is read twice, so pass a written table. About one in eight of the others is true."""
    words = min(MOST_BITS, 1 << max(4, (keys.count() // 8).bit_length()))
    word = F.pmod(F.xxhash64(key), F.lit(words)).cast("int")
    bit = F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(64)).cast("int")
    bits = keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    may = F.coalesce(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left").select(*(F.col(f"`{c}`") for c in rows.columns), may.alias("_may"))


def left_out(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` whose `key` is none of `keys`; rows with a null key stay. Both tables are read twice."""
    asked = told(rows, keys, key)
    return asked.where("not _may").drop("_may").unionByName(asked.where("_may").drop("_may").join(keys, key, "left_anti").select(*rows.columns))


def starred(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars at their least nodes: each u in one edge, and no v the u of another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    ends = ends.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return not ends.where("as_u > 1 or (as_u = 1 and as_v = 1)").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `links` (a, b: long) reaches.

    Alternates large-star and small-star steps on an edge table of at most one row per link until all components are
    stars; each step aggregates with map-side minima and looks the minima of nodes with very many links up by broadcast, so
    that a star's centre is no task of its own. Each result is written in the shared folder, and nothing but booleans and
    counts comes to the driver. Links with a null end and loops are ignored; a table without links gives an empty result.
    The number of rounds is logarithmic in the longest path; past `most_rounds` this raises.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "links",
    )
    rounds = 0
    while not starred(edges):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = looked_up(both, low, "u", 2 * edges.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "links")
        discard(low, edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = written(low, "low")
        small = looked_up(large, low, "u", large.count()).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        small = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(low, large)
        edges = small
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._quire_path = edges._quire_path  # for discard()
    return out
