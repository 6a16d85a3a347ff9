"""MinHash near-dedup of documents.

Documents of one shingle set are one class. A class's signature keeps the minimum and the maximum of its shingle hashes
under each permutation, so that half the permutations give all values; bands of them are buckets. In a bucket every
class is compared with the smallest one (by full sets). Buckets whose classes are then still of several components are
compared in blocks, all classes with all, so that no link is lost; only links that join components leave a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, discard, looked_up, told, written

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """words: of a shingle. percent: of the union that linked sets share at least. bands and rows: of the signature; with
    40 bands of 5, a pair at 75 % is in no common bucket once in 50,000. block, block_shingles: classes of a bucket that are
    compared at once, and their shingles, about. star: members that are sent to one copy of their head."""

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    block: int = 2048
    block_shingles: int = 1_000_000
    star: int = 1024


class Words:
    """64-bit hashes of words, remembered."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > self.most:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of n words (all of them if there are fewer)."""
    said = text.encode().lower().split() if text else []  # bytes: lower() is for A-Z and split() for ASCII white space alone
    if not said:
        return np.zeros(0, np.uint64)
    w = words(said)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * MIX
        h ^= h >> np.uint64(32)
    return np.unique(h)


def permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    n = (p.bands * p.rows + 1) // 2
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def band_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit value for each band of the min-max signature of shingle hashes h."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(h), 2048):
        x = np.multiply.outer(a, h[at : at + 2048]) + b[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    values = np.concatenate([low, high])[: p.bands * p.rows].reshape(p.rows, p.bands)
    out = np.arange(1, p.bands + 1, dtype=np.uint64) * MIX
    for row in values:
        out = (out ^ row) * MIX
        out ^= out >> np.uint64(29)
    return out


def _signed(p: Params, sets: bool):
    """doc_id, n_shingles, digest of the set in two halves, then its bands, or (sets) the set itself."""

    def run(batches):
        words, (a, b) = Words(), permutations(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(at, 512)
                sizes, digests, more = [], [], []
                for text in batch.column(1).slice(at, 512):
                    h = shingles(text.as_py(), p.words, words)
                    sizes.append(len(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    if sets:
                        more.append(h.tobytes())
                    else:
                        more.append(band_hashes(h, a, b, p).view(np.int64) if len(h) else np.zeros(0, np.int64))
                if sets:
                    last = pa.array(more, pa.binary())
                else:
                    ends = np.r_[0, np.cumsum([len(x) for x in more])]
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(more) if more else np.zeros(0, np.int64)))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), last], ["doc_id", "n_shingles", "d1", "d2", "h" if sets else "bands"])

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _verified(percent: int):
    """Rows in order of head and part, each head's set before those of its members; leaves (a, b) of the members linked."""

    def run(batches):
        head, x = None, None
        for batch in batches:
            a, b, tags, h = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            out = []
            for i, (u, v, tag) in enumerate(zip(a, b, tags, strict=True)):
                y = np.frombuffer(h[i].as_buffer(), np.uint64)
                if v is None:
                    head, x = (u, tag), y.copy()
                elif head == (u, tag):
                    n = overlap(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    if n > 0 and 100 * n >= percent * (len(x) + len(y) - n):
                        out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in out], pa.int64()), pa.array([q[1] for q in out], pa.int64())], ["a", "b"])

    return run


def block_links(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets of different components of one bucket's block pair (left: side of each row), a link for
    each two components that some link joins. Common values are counted over those that two sets or more have."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    row, col, width = owner[shared], column[inverse[shared]], int((counts > 1).sum())
    rows, cols = np.flatnonzero(left), np.flatnonzero(~left) if not left.all() else np.flatnonzero(left)
    common = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, width, 4096):  # dense slices of the shared values
        lo, hi = np.searchsorted(col, [at, at + 4096])
        M = np.zeros((len(sets), min(4096, width - at)), np.float32)
        M[row[lo:hi], col[lo:hi] - at] = 1
        common += M[rows] @ M[cols].T
    linked = 100 * common >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - common)
    linked &= (common > 0) & (comps[rows][:, None] != comps[cols][None, :])
    i, j = np.nonzero(linked)
    found = {}
    for x, y in zip(rows[i].tolist(), cols[j].tolist(), strict=True):
        c, d = int(comps[x]), int(comps[y])
        found.setdefault((min(c, d), max(c, d)), (int(ids[x]), int(ids[y])))
    return [*found.values()]


def _blocks(percent: int):
    import pandas as pd

    def run(pdf):
        sets = [np.frombuffer(x, np.uint64) for x in pdf["h"]]
        got = block_links(pdf["doc_id"].to_numpy(), pdf["comp"].to_numpy(), pdf["left"].to_numpy(bool), sets, percent)
        return pd.DataFrame({"a": [x for x, _ in got], "b": [y for _, y in got]}, dtype="int64")

    return run


def near_duplicates(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs with an id.

    Documents without words have an empty set and are linked with nothing. Rows that share an id are one document: it is
    linked by each of their sets, and each row has its own n_shingles. Rows with a null id are left out. Only ids and texts
    are read, so that other columns can't clash.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    signed = written(rows.mapInArrow(_signed(p, False), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signed")
    # Equal sets are one class, named by its smallest document. A class is known by that id and a tag, which tells an id's
    # sets apart: 0 where it has one, else half of the set's digest.
    digest = ["d1", "d2"]
    full = signed.where("n_shingles > 0").select("doc_id", "n_shingles", *digest)
    classes = written(full.groupBy(*digest).agg(F.min("doc_id").alias("class"), F.count("*").alias("n"), F.max("doc_id").alias("last")), "classes")
    several = written(full.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo != hi").select("doc_id", F.lit(True).alias("several")), "several")
    tag = F.when(F.col("several"), F.col("d1")).otherwise(F.lit(0).cast("long")).alias("tag")
    own = signed.where("n_shingles > 0").join(classes.select(*digest, F.col("class").alias("doc_id")), ["doc_id", *digest], "left_semi")
    own = written(own.join(several, "doc_id", "left").select("doc_id", tag, "n_shingles", "bands").dropDuplicates(["doc_id", "tag"]), "own")
    hits = own.select("doc_id", "tag", "n_shingles", F.explode("bands").alias("bucket"))
    # Most classes are alone in their buckets: these go before anything else is asked of them.
    met = written(hits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "met")
    hits = written(looked_up(hits, met, "bucket", own.count() * p.bands), "hits")
    n_hits, me = hits.count(), F.struct("doc_id", "tag")
    buckets = written(hits.groupBy("bucket").agg(F.min(me).alias("head"), F.count("*").alias("n")), "buckets")
    stars = looked_up(hits.drop("n"), buckets, "bucket", n_hits).where(me != F.col("head"))
    stars = written(stars.select("head", "doc_id", "tag", "n_shingles").distinct(), "stars")
    # The texts of other documents than these are mostly told by bits, so that no text is dealt.
    wanted = written(hits.select("doc_id", "tag").distinct(), "wanted")
    sets = told(rows, wanted, "doc_id").where("_may").select("doc_id", "text").mapInArrow(_signed(p, True), "doc_id long, n_shingles long, d1 long, d2 long, h binary")
    sets = sets.join(several, "doc_id", "left").select("doc_id", tag, "h").join(wanted, ["doc_id", "tag"], "left_semi")
    sets = written(sets.dropDuplicates(["doc_id", "tag"]), "sets")
    # A head's members are dealt into parts of bounded size; the head's set goes to each part once, and before its members.
    parts = stars.groupBy("head").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).select("head", "n", F.ceil(F.greatest(F.col("n") / p.star, F.col("size") / p.block_shingles)).cast("int").alias("parts"))
    parts = written(parts, "parts")
    members = looked_up(stars, parts, "head", stars.count()).withColumn("part", F.pmod(F.xxhash64("doc_id", "tag"), "parts").cast("int")).join(sets, ["doc_id", "tag"])
    heads = parts.select("head.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets, ["doc_id", "tag"])
    sent = members.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("head.tag").alias("tag"), "h", "part").unionByName(
        heads.select(F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "tag", "h", "part")
    )
    sent = sent.repartition("a", "tag", "part").sortWithinPartitions("a", "tag", "part", F.col("b").asc_nulls_first())
    links = sent.select("a", "b", "tag", "h").mapInArrow(_verified(p.percent), "a long, b long").distinct()
    # A document of several sets is in all their classes.
    bridges = full.join(several, "doc_id", "left_semi").select("doc_id", *digest).distinct().join(classes.where("n > 1"), digest).where("doc_id != class")
    links = written(links.unionByName(bridges.select(F.col("class").alias("a"), F.col("doc_id").alias("b"))), "links")
    comps = components(links)
    # What the stars leave open: buckets of three and more classes in several components.
    placed = hits.where("n > 2").drop("n").join(comps, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "tag", "n_shingles", F.coalesce("component", "doc_id").alias("comp"))
    placed = written(placed, "open")
    open_ = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    open_ = written(open_.select("bucket", "n", F.ceil(F.greatest(F.col("n") / p.block, F.col("size") / p.block_shingles)).cast("int").alias("parts")), "open")
    left_open = looked_up(placed.drop("n_shingles"), open_, "bucket", placed.count())
    # Each class goes to every pair of its bucket's blocks that its own block is in.
    part = F.pmod(F.xxhash64("doc_id", "tag"), F.col("parts")).cast("int")
    spread = left_open.withColumn("part", part).select("bucket", "doc_id", "tag", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("bucket", "doc_id", "tag", "comp", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") <= F.col("other")).alias("left"))
    more = spread.join(sets, ["doc_id", "tag"]).groupBy("bucket", "x", "y").applyInPandas(_blocks(p.percent), "a long, b long")
    more = written(more.distinct(), "more")
    if more.limit(1).count():
        discard(comps)
        comps = components(links.unionByName(more))
    # Classes of one document are that document's; only the others are looked up.
    named = written(classes.where("class != last").join(comps, F.col("class") == F.col("node"), "left").select(*digest, "n", F.coalesce("component", "class").alias("component")), "named")
    copies = looked_up(full.select("doc_id", *digest), named, digest, signed.count()).groupBy("doc_id").agg(F.min("component").alias("of_copies"))
    out = signed.select("doc_id", "n_shingles").join(comps, F.col("doc_id") == F.col("node"), "left").join(copies, "doc_id", "left")
    component = F.least(F.coalesce("component", "doc_id"), F.coalesce("of_copies", "doc_id"))
    out = written(out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "near")
    discard(signed, classes, several, own, met, hits, buckets, stars, wanted, sets, parts, links, comps, placed, open_, more, named)
    return out
