import hashlib
import random

import duckdb
import numpy as np

from quire.llm.queries import op9_suffix_dedup
from quire.llm.suffix_dedup import WIDTH, coded, decoded, merged, prefixes, remove_repeats


def brute(rows):
    least = {}
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in rows:
        for i in range(len(t) - WIDTH + 1):
            w = t[i : i + WIDTH]
            if d < least.get(w, 2**64):
                least[w] = d
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - WIDTH + 1):
            if least[t[i : i + WIDTH]] < d:
                gone[i : i + WIDTH] = True
        edge = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((None if d == 2**63 - 1 else d, len(t), int(gone.sum()), edge, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = []
        for _ in range(k):
            m = sorted(bytes(rng.choices(b"ab\0", k=9)) for _ in range(rng.randint(0, 40)))
            rows = np.frombuffer(b"".join(m), np.uint8).reshape(-1, 9)
            lcp, rest = coded(rows)
            assert decoded(np.frombuffer(lcp, np.uint8).astype(int), rest, 9).tobytes() == rows.tobytes()
            runs.append((m, list(lcp)))
        every = [s for m, _ in runs for s in m]
        order, common = merged(runs)
        got = [every[i] for i in order]
        assert got == sorted(every)
        if got:
            assert common == prefixes(np.frombuffer(b"".join(got), np.uint8).reshape(-1, 9)).tolist()


def test_equals_brute_force_on_a_table(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_equals_brute_force_on_pieces(spark):
    rng = random.Random(4)
    shared = ["".join(rng.choices("abcdé", k=rng.randint(40, 200))) for _ in range(12)] + ["a" * 90, "ab" * 60, "x\0y" * 30]
    rows = []
    for d in range(120):
        t = "".join(rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.5 else "".join(rng.choices("abcdef ", k=rng.randint(0, 80))) for _ in range(rng.randint(0, 5)))
        rows.append((d, t))
    rows += [(200, None), (201, ""), (202, "a" * 49), (203, "a" * 50), (5, rows[7][1]), rows[9], rows[9], (None, rows[3][1] + "zz"), (None, rows[3][1] + "zz"), (204, "long " * 30000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")
    for size in (1 << 22, 3000):
        assert digest(remove_repeats(docs, block_bytes=size).collect()) == brute(rows)
    assert remove_repeats(docs.where("false")).count() == 0


def test_periodic_text_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from quire.llm import suffix_dedup as S

    text = "a" * (2 << 20)
    docs = pa.table({"doc_id": [1, 2], "text": [text, "ab" * 500 + "a" * 300], "block": pa.array([0, 0], pa.int64())})
    tracemalloc.start()
    hashes = S._hashes(1)(docs)
    runs = S._runs(1)(docs, S._shared(hashes))
    S._spans(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20, peak


def test_long_texts_are_blocks_of_their_own(spark):
    from pyspark.sql import functions as F

    from quire.llm.suffix_dedup import placed

    rows = spark.createDataFrame([(i % 3, ("t%d " % i) * 400) for i in range(12)] + [(None, "short"), (1, None)], "doc_id long, text string")
    got = rows.withColumn("b", placed("doc_id", "text", 4, 2000)).select("b", F.length("text").alias("n")).collect()
    long = [r.b for r in got if (r.n or 0) >= 1000]
    assert len(set(long)) == len(long) == 12 and min(long) >= 4 and all(r.b < 4 for r in got if (r.n or 0) < 1000)
