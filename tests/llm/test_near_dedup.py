import random

import duckdb
import numpy as np

from quire.llm.near_dedup import Params, Words, block_links, near_duplicates, shingles
from quire.llm.queries import op2_near_dedup


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    s = {d: sets(t) for d, t in rows if d is not None}
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 75 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s[d]), root(d)) for d in ids}


def test_equals_brute_force_on_a_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_equals_brute_force_on_edited_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows, n = [], 0
    for family in range(4):
        base = [word() for _ in range(120)]
        for _ in range(60):
            t = list(base)
            for i in rng.sample(range(120), rng.randint(0, 7)):
                t[i] = word()
            rows.append((n, " ".join(t), family))
            n += 1
    rows += [(n, "", 0), (n + 1, None, 0), (n + 2, "One two", 0), (n + 3, "one TWO", 0), (n + 4, " \t\n ", 0), (n + 5, "x " * 40000, 0), (n + 6, "É one two three four", 0), (n + 7, "é one two three four", 0), (n + 8, "a b c", 0)]
    docs = spark.createDataFrame([*rows, (None, "one two", 0), rows[3]], "doc_id long, text string, component_id int")
    for p in (Params(), Params(block=25)):
        got = near_duplicates(docs, p).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([r[:2] for r in rows])
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(docs.where("false")).count() == 0


def test_block_links_find_every_joined_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    s = [np.unique(np.r_[base[: rng.integers(70, 100)], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]) for _ in range(40)]
    ids, comps = np.arange(40), np.arange(40)
    got = {tuple(sorted(x)) for x in block_links(ids, comps, np.ones(40, bool), s, 75)}
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * (n := len(np.intersect1d(s[i], s[j]))) >= 75 * (len(s[i]) + len(s[j]) - n)}
    assert got == want


def test_shingles():
    w = Words()
    assert len(shingles("a b c d e f a b c d e", 5, w)) == 7 - 1 and len(shingles("a b", 5, w)) == 1 and not len(shingles(" ", 5, w))


def test_rows_that_share_an_id_are_linked_by_each_set(spark):
    rng = random.Random(12)
    a, b = ([["".join(rng.choices("abcdef", k=5)) for _ in range(200)] for _ in range(2)])
    like = lambda t: " ".join([*t[:190], *["new"] * 3])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, like(a)), (3, like(b)), (4, " ".join(a)), (6, "alone"), (6, "by itself"), (6, "alone")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert {d: c for (d, _), c in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6} and len(got) == 5
    # A document of two classes joins them.
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(a)), (3, " ".join(b)), (7, like(b))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 2, 3: 2, 5: 2, 7: 2}


def test_large_groups_are_dealt_out(spark, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rng = random.Random(13)
    base = ["".join(rng.choices("abcdef", k=5)) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(10, 60)] + [(i, " ".join([*base[:110], f"tail{i}"])) for i in range(100, 160)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Params(star=7)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in brute(rows).items()}


def test_components_of_paths_and_stars(spark, monkeypatch):
    from quire.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    links = [(i, i + 1) for i in range(1, 12)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    try:
        common.components(spark.createDataFrame(links, "a long, b long"), most_rounds=1)
    except RuntimeError:
        return
    raise AssertionError("the limit of rounds must raise")


def test_rows_are_left_out_without_a_shuffle_of_most(spark):
    from quire.llm.common import left_out, told, written

    docs = written(spark.range(20_000).selectExpr("if(id % 5000 = 7, null, id) as doc_id", "cast(id as string) as text").unionByName(spark.createDataFrame([(9, "again"), (9, "again")], "doc_id long, text string")), "docs")
    for gone in (spark.range(0, 20_000, 9).selectExpr("id as doc_id"), spark.range(0), docs.select("doc_id")):
        gone = written(gone.toDF("doc_id"), "gone")
        want = sorted(r.text for r in docs.join(gone, "doc_id", "left_anti").collect())
        got = left_out(docs, gone, "doc_id")
        assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == want
        may = told(docs, gone, "doc_id").where("_may")
        assert not docs.join(gone, "doc_id", "left_semi").join(may, "doc_id", "left_anti").count()
        assert may.count() <= gone.count() + 0.2 * 20_000
