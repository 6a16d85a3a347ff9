import re

import duckdb

from quire.llm import decontamination
from quire.llm.decontamination import contained
from quire.llm.queries import ORACLE_SQL, op1_decontamination

SF = "/root/testdata/sf0.01"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = {(a, b): d for a, b, c_, d in c.sql("select doc_id, item_id, shared, containment from (" + ORACLE_SQL["op1_decontamination"] + ")").fetchall()}
    got = {(r.doc_id, r.item_id): r.containment for r in op1_decontamination(spark, SF).collect()}
    assert got == want and got


def test_edges(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    edited = item.replace("w15", "x")  # 21 of 26 shingles
    worse = edited.replace("w7 ", "y ")
    docs = [(1, "long " * 30000 + item.upper() + " tail " * 9), (2, edited), (3, worse), (4, None), (None, item), (5, ""), (6, "say two words now"), (1, "again"), (7, "two"), (8, "a b c d")]
    items = [(1, item), (2, "two words"), (3, None), (4, ""), (5, item), (6, "a b c d")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.shared for r in contained(d, b).collect()}
    assert got == {(1, 1): 26, (1, 5): 26, (2, 1): 21, (2, 5): 21, (6, 2): 1, (8, 6): 1}
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 30)  # items in several blocks
    assert {(r.doc_id, r.item_id): r.shared for r in contained(d, b).collect()} == got
    assert contained(d.where("false"), b).count() == contained(d, b.where("false")).count() == 0


def test_no_text_is_dealt(spark):
    """Candidates are told by what they hit: an exchange of texts would be larger than the documents."""
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g "), "id").alias("text"))
        items = spark.createDataFrame([(1, "a b c d e f g 7"), (2, "c d")], "item_id long, text string")
        got = contained(docs, items)
        plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert dealt and not [x for x in dealt if re.search(r"\b(w|text)#", x)]
        assert {(r.doc_id, r.item_id): r.shared for r in got.collect()} == {(i, 1): 3 + (i == 7) for i in range(50)} | {(i, 2): 1 for i in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
