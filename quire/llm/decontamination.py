"""Benchmark decontamination: which documents contain which test items.

Items are partitioned by size (powers of two of their shingle counts). Each item keeps its least shingle hashes, as many
as its partition needs: an item of n shingles whose containment is t lacks (1 - t) n of them at most, so that of a
sketch of more than (1 - t) n hashes some must be in the document, however long that is. Documents whose shingles hit
enough of a sketch are candidates, and are verified by the exact share of the item's shingles that they contain.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle.
WORDS = 5
#: Shingles of items that are broadcast at once, and bytes of their words; more items are taken in blocks, each against all documents.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of anything but ASCII white space."""
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")


def shingled(rows: DataFrame, n: int) -> DataFrame:
    """A row for each run of n words of rows.w (array), with the words in columns w0, w1, ... and without w."""
    at = [F.col("w")] + [F.slice(F.col("w"), i + 1, F.greatest(F.size("w") - i, F.lit(0))) for i in range(1, n)]
    keep = [c for c in rows.columns if c != "w"]
    zipped = F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(at)]) if n > 1 else F.transform("w", lambda x: F.struct(x.alias("w0")))
    out = rows.where(F.size("w") >= n).select(*keep, F.inline(zipped).alias(*[f"w{i}" for i in range(n)]))
    return out.where(F.col(f"w{n - 1}").isNotNull())


def hashed(n: int) -> Column:
    return F.xxhash64(*[F.col(f"w{i}") for i in range(n)])


def joined(n: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"w{i}") for i in range(n)])


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, containment) for each document that holds `threshold` or more of an item's shingles.

    Shingles are five words; an item of fewer words is one shingle of its own, and is found where its words stand in a
    row. Rows with a null id or text, and texts without words, are in no pair; rows that share an id count as one text.
    Only ids and texts are read, so that other columns can't clash. Items are taken in blocks of bounded size, so that a set
    of any size is searched; documents are read once for each block.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    lengths = [r.n for r in items.select(F.least(F.size("w"), F.lit(WORDS)).alias("n")).distinct().collect()]  # five values at most
    spoken = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = []
    for n in sorted(lengths):
        every = items.where(F.size("w") >= n if n == WORDS else F.size("w") == n)
        told = shingled(every, n).agg(F.count("*").alias("rows"), F.sum(F.octet_length(joined(n))).alias("bytes")).first()
        blocks = max(1, -(-told["rows"] // BROADCAST_ROWS), -(-(told["bytes"] or 0) // BROADCAST_BYTES))
        for k in range(blocks):
            own = every.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else every
            # No key of a join is dealt to one task: a block's shingles go to all of them.
            whole = shingled(own, n).select("item_id", hashed(n).alias("h"), joined(n).alias("s")).distinct()
            sizes = whole.groupBy("item_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_set("h")).alias("hs"))
            # The partition's upper bound sets the sketch; `need` of its hashes are in every document that qualifies.
            bound = F.pow(F.lit(2), F.ceil(F.log2(F.col("size"))))
            kept = F.least(F.size("hs"), (F.floor(bound * (1 - threshold)) + 1).cast("int"))
            need = F.greatest(F.lit(1), kept - (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9)))
            sketch = sizes.select("item_id", need.alias("need"), F.explode(F.slice("hs", F.lit(1), kept)).alias("h"))
            hits = shingled(spoken, n).select("doc_id", hashed(n).alias("h")).join(F.broadcast(sketch), "h")
            likely = hits.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need").select("doc_id", "item_id")
            # No text is dealt: all documents are looked up, by hash and then by words, and candidates' hits are kept.
            said = shingled(spoken, n).withColumn("h", hashed(n)).join(F.broadcast(whole.select("h").distinct()), "h", "left_semi")
            said = said.select("doc_id", "h", joined(n).alias("s")).join(F.broadcast(whole), ["h", "s"]).select("doc_id", "item_id", "s").distinct()
            shared = said.join(likely, ["doc_id", "item_id"], "left_semi")
            shared = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(F.broadcast(sizes.select("item_id", "size")), "item_id")
            found.append(shared.where(F.col("shared") >= F.col("size") * threshold - 1e-9).select("doc_id", "item_id", "shared", (F.col("shared") / F.col("size")).alias("containment")))
    if not found:
        return docs.select("doc_id", F.lit(None).cast(dict(items.dtypes)["item_id"]).alias("item_id"), F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("containment")).where("false")
    return reduce(DataFrame.unionByName, found)
