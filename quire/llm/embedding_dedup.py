"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the product of both is a grid of cells, and each
vector is kept in the cell of its nearest pair of codewords, under its label. A multi-sequence traversal visits a query's
cells in ascending order of distance. How many are visited is set by planted neighbours at the least cosine that counts:
as many as reach the wanted share of them. What is met in a cell is verified by cosine in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, written


@dataclass(frozen=True)
class Params:
    """least: cosine of linked vectors. recall: share of planted neighbours at that cosine that the visited cells hold.
    words: codewords of a half at most, and they grow with the root of the table, so that a cell holds about `cell` vectors
    up to words**2 * cell of them. sample: vectors that codebooks are fitted on at least, or 16 a codeword (65,536 at most).
    exact: vectors of a length that are compared without an index, as one cell. block: vectors of a cell that are compared
    at once."""

    least: float = 0.93
    recall: float = 0.995
    sample: int = 8192
    words: int = 4096
    cell: int = 200
    exact: int = 500
    block: int = 4096
    seed: int = 7


#: Rows of the table of large cells that are broadcast at most.
BROADCAST_ROWS = 100_000


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means, started from distinct rows; an empty word stays where it was."""
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def traversal(d1: np.ndarray, d2: np.ndarray, most: int) -> list[int]:
    """Cells (i * len(d2) + j) by ascending d1[i] + d2[j], the first `most`."""
    o1, o2, n = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist(), len(d2)
    a, b = d1[o1].tolist(), d2[o2].tolist()
    out, heap = [], [(a[0] + b[0], 0, 0)]
    done = [-1] * len(a)  # the last column taken of each row
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(o1[i] * n + o2[j])
        done[i] = j
        # The next cell of a row or column may be taken once both its lower neighbours are.
        if j + 1 < len(b) and (i == 0 or done[i - 1] >= j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j - 1:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return out


@dataclass(frozen=True)
class Index:
    one: np.ndarray
    two: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.one.shape[1]
        return distances(x[:, :cut], self.one), distances(x[:, cut:], self.two)

    def home(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.halves(x)
        return d1.argmin(1) * len(self.two) + d2.argmin(1)


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large and very small components would not fit
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codewords(total: int, p: Params) -> int:
    return int(min(p.words, max(2, round((total / p.cell) ** 0.5))))


def fit(sample: np.ndarray, total: int, p: Params) -> Index:
    """Codebooks from unit vectors, and the number of cells to visit, from planted neighbours of up to 1,000 of them."""
    rng = np.random.default_rng(p.seed)
    cut = sample.shape[1] // 2
    k = codewords(total, p)
    index = Index(codebook(sample[:, :cut], k, rng), codebook(sample[:, cut:], k, rng), 1)
    q = sample[rng.permutation(len(sample))[:1000]]
    away = rng.standard_normal(q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
    planted = p.least * q + (1 - p.least**2) ** 0.5 * away
    ranks = np.minimum(_ranks(index, q, index.home(planted)), _ranks(index, planted, index.home(q)))  # either may visit the other
    return Index(index.one, index.two, int(np.quantile(ranks, p.recall, method="higher")) + 1)


def _ranks(index: Index, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How many cells are nearer to x than `cell`."""
    d1, d2 = index.halves(x)
    i, j = np.divmod(cell, len(index.two))
    rows = np.arange(len(x))
    edge = d1[rows, i] + d2[rows, j] - 1e-12
    d2.sort(1)
    return np.array([np.searchsorted(b, t - a).sum() for a, b, t in zip(d1, d2, edge, strict=True)])


def _cells(index: Index):
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = unit(f["embedding"])
            home = index.home(x)
            d1, d2 = index.halves(x)
            f["home"] = home
            f["visits"] = [traversal(a, b, index.visits) for a, b in zip(d1, d2, strict=True)]
            yield f

    return run


def _meet(least: float):
    """The vectors that live in a cell and those that visit it: direct links counted once a pair and end, and the ends
    joined to the least vector that they reach in this group."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, ids, copies = unit(f["embedding"]), f["vec_id"].to_numpy(), f["copies"].to_numpy()
        lives, home = f["lives"].to_numpy(bool), f["home"].to_numpy()
        H, V = np.flatnonzero(lives), np.flatnonzero(~lives)
        width = int(max(home.max(), max((max(v) for v in f["visits"] if len(v)), default=0))) + 1
        seen = np.unique(np.concatenate([i * width + np.asarray(f["visits"].iloc[h]) for i, h in enumerate(H)])) if len(H) else np.zeros(0, int)
        n, label = np.zeros(len(f), np.int64), ids.copy()
        links = []
        for at in range(0, len(V), 1024):
            v = V[at : at + 1024]
            i, j = np.nonzero((x[v] @ x[H].T >= least) & (ids[v][:, None] != ids[H][None, :]))
            a, b = v[i], H[j]
            np.add.at(n, b, copies[a])
            # The pair is met again where a lives, if b goes there; else it counts for a here.
            key = j * width + home[a]
            again = seen[np.minimum(np.searchsorted(seen, key), max(len(seen) - 1, 0))] == key if len(seen) else np.zeros(len(key), bool)
            np.add.at(n, a[~again], copies[b[~again]])
            links.append((a, b))
        a, b = (np.concatenate([q[k] for q in links]) if links else np.zeros(0, int) for k in (0, 1))
        while len(a):  # least reachable id, by passing minima along the links
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (before == label).all():
                break
        some = (n > 0) | (label != ids)
        return pd.DataFrame({"vec_id": ids[some], "n": n[some], "low": label[some]})

    return run


def near_vectors(vectors: DataFrame, p: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each distinct id.

    Vectors that are null, empty, zero or hold null or non-finite values, and those with a null label, are linked with
    nothing; so are vectors of different lengths with one another. Of rows that share an id the least counts; rows with a
    null id are left out. Equal vectors of a label are searched for once and count as links to one another.
    """
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"  # half the bytes to shuffle
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(kind).alias("embedding")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*")
    inf = F.lit(float("inf"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") >= 2) & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = written(rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("embedding")), "vectors")
    classes = rows.where("usable").groupBy("dim", "label", "embedding").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies"))
    classes = written(classes.select(F.col("class").alias("vec_id"), "dim", "label", "embedding", "copies"), "classes")
    sizes = written(classes.groupBy("dim").agg(F.count("*").alias("total")), "sizes")
    few = classes.join(sizes.where(F.col("total") <= p.exact).select("dim"), "dim", "left_semi")
    zero = F.lit(0).cast("long")
    placed = few.select("vec_id", "dim", "label", "embedding", "copies", zero.alias("home"), F.array(zero).alias("visits"))
    for dim, total in [(r.dim, r.total) for r in sizes.where(F.col("total") > p.exact).orderBy("dim").collect()]:  # a model a length
        own = classes.where(F.col("dim") == dim)
        most = min(65_536, max(p.sample, 16 * codewords(total, p)))
        share = min(1.0, 2 * most / total)
        drawn = own.where(F.xxhash64("vec_id") <= F.lit(-(2**63) + min(2**64 - 1, int(2**64 * share)))).orderBy(F.xxhash64("vec_id")).limit(most).select("embedding").collect()
        index = fit(unit([r.embedding for r in drawn]), total, p)
        placed = placed.unionByName(own.mapInPandas(_cells(index), f"vec_id long, dim int, label string, embedding {kind}, copies long, home long, visits array<long>"))
    placed = written(placed, "placed")
    lives = placed.withColumn("cell", F.col("home")).withColumn("lives", F.lit(True))
    visits = placed.withColumn("cell", F.explode("visits")).withColumn("lives", F.lit(False))
    # Large cells are cut into blocks of residents and of visitors; each of one meets each of the other.
    count = lambda df, name: df.groupBy("dim", "label", "cell").agg(F.ceil(F.count("*") / p.block).cast("int").alias(name))
    blocks = written(count(lives, "hs").join(count(visits, "vs"), ["dim", "label", "cell"]).where("hs > 1 or vs > 1"), "blocks")
    if blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    both = lives.unionByName(visits.withColumn("visits", F.array().cast("array<long>"))).join(blocks, ["dim", "label", "cell"], "left")
    both = both.withColumns({"hs": F.coalesce("hs", F.lit(1)), "vs": F.coalesce("vs", F.lit(1))})
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("lives"), F.col("hs")).otherwise(F.col("vs"))).cast("int")
    other = F.when(F.col("lives"), F.col("vs")).otherwise(F.col("hs"))
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    both = both.withColumn("h", F.when(F.col("lives"), F.col("own")).otherwise(F.col("other"))).withColumn("v", F.when(F.col("lives"), F.col("other")).otherwise(F.col("own")))
    met = written(both.groupBy("dim", "label", "cell", "h", "v").applyInPandas(_meet(p.least), "vec_id long, n long, low long"), "met")
    n = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = components(met.where("low != vec_id").select(F.col("low").alias("a"), F.col("vec_id").alias("b")))
    told = classes.join(n, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    told = told.select("dim", "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("component"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("usable").join(told, ["dim", "label", "embedding"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
