import numpy as np
import pandas as pd

from quire.llm.embedding_dedup import near_vectors, traversal, unit
from quire.llm.queries import op5_embedding_dedup


def brute(ids, x, labels, least=0.93):
    n, comp = {}, {}
    ok = [i for i in range(len(ids)) if labels[i] is not None and x[i] is not None and len(x[i]) and all(v is not None and np.isfinite(v) for v in x[i]) and any(v != 0 for v in x[i])]
    parent = {int(i): int(i) for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = {int(i): 0 for i in ids}
    for lab in {labels[i] for i in ok}:
        own = [i for i in ok if labels[i] == lab]
        u = unit([x[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)), strict=True):
            i, j = int(ids[own[a]]), int(ids[own[b]])
            n[i] += 1
            n[j] += 1
            lo, hi = sorted((root(i), root(j)))
            parent[hi] = lo
    return {i: (n[i], root(i)) for i in parent}


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.random(6), rng.random(5)
        assert traversal(a, b, 30) == np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable").tolist()


def test_recall_against_brute_force(spark, tmp_path):
    """Real vectors, and for each fifth one a neighbour whose cosine is 0.931 to 0.99."""
    pdf = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.default_rng(3)
    q = unit(pdf["embedding"])[::5]
    away = rng.standard_normal(q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.99, (len(q), 1))
    more = pd.DataFrame({"vec_id": np.arange(len(q)) + 1_000_000, "embedding": list((c * q + np.sqrt(1 - c * c) * away).astype(np.float32)), "label": pdf["label"].to_numpy()[::5]})
    pdf = pd.concat([pdf, more], ignore_index=True)
    pdf.to_parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(pdf["vec_id"].tolist(), list(pdf["embedding"]), pdf["label"].tolist())
    got = {r.vec_id: (r.n_links, r.component_id) for r in op5_embedding_dedup(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    links = sum(n for n, _ in want.values())
    assert links >= 700 and sum(n for n, _ in got.values()) >= 0.99 * links


def test_clusters_copies_and_edges(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = [(k, [float(v) for v in base[k % 30] + 0.15 * rng.standard_normal(16)], k % 2) for k in range(400)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(5)] + [(2000, rows[3][1], None), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, [], 1), (2006, rows[3][1][:8], 1), (2007, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, copies string")
    want = brute([r[0] for r in rows if r[0] != 2006], [r[1] for r in rows if r[0] != 2006], [r[2] for r in rows if r[0] != 2006])
    from quire.llm.embedding_dedup import Params

    for p in (Params(recall=1.0), Params(recall=1.0, block=16)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, p).collect()}
        assert got.pop(2006) == (0, 2006)
        share = sum(got[i] == want[i] for i in want) / len(want)
        assert got.keys() == want.keys() and share >= 0.97, share
    assert near_vectors(df.where("false")).count() == 0


def test_very_large_small_and_rare_lengths(spark):
    from quire.llm.embedding_dedup import near_vectors

    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2.01e-200], 1), (3, [2.0, -1.0], 1), (4, [0.0, 0.0], 1)]
    rows += [(10 * n + i, [float(n), *([1.0] * (n - 2)), 1.0 + i / 1000], 7) for n in range(3, 12) for i in range(2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[1] == got[2] == (1, 1) and got[3] == (0, 3) and got[4] == (0, 4)
    assert all(got[10 * n + i] == (1, 10 * n) for n in range(3, 12) for i in range(2))
