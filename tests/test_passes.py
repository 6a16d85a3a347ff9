import json

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import passes as P


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def boxes(df, *names):
    for n in names:
        df = df.withColumn(n, G.box(F.col(n)[0], F.col(n)[1], F.col(n)[2], F.col(n)[3]))
    return df


def test_sendable_and_solitary(spark):
    p = frame(spark, "debug_id string, text string, vertical boolean, layout_label string", ("a", "long enough", False, "text"), ("b", "short"[:4], None, "text"), (None, "no id here", None, "text"), ("c", "upright text", True, "text"), ("d", "(cid:1)(cid:2)", None, "text"), ("e", "a heading", None, "title"))
    assert {r.debug_id for r in P.sendable(p).collect()} == {"a", "e"}
    assert {r.debug_id for r in P.sendable(p, frame(spark, "debug_id string", ("e",)), body_only=True).collect()} == {"a"}
    u = boxes(frame(spark, "p int, i int, box array<double>, font_size double", (1, 1, [0.0, 0.0, 10.0, 10.0], 10.0), (1, 2, [15.0, 0.0, 20.0, 10.0], 10.0), (1, 3, [0.0, 50.0, 5.0, 60.0], 10.0)), "box")
    assert {r.i for r in P.solitary(u, ["p"], "i").collect()} == {3}


def test_columns_classes_and_boundaries(spark):
    u = frame(spark, "doc int, page int, column int, reading int, par_idx int", (1, 1, 0, 1, 10), (1, 1, 0, 2, 11), (1, 1, 1, 3, 12), (1, 2, 0, 1, 13))
    got = {(r.tail, r.head, r.skip) for r in P.page_column_pairs(u, ["doc"]).collect()}
    assert got == {(11, 12, 1), (12, 13, 1), (11, 13, 2)}
    labels, classes = frame(spark, "chain_id int, label string", (1, "text"), (1, "plain"), (2, "text"), (2, "title")), frame(spark, "class string, label string", ("body", "text"), ("body", "plain"), ("head", "title"))
    assert {r.chain_id: r["class"] for r in P.class_of_labels(labels, classes).collect()} == {1: "body", 2: None}
    pairs = frame(spark, "boundary string, pair string, eligible boolean, reason string, punct double, style double", ("1->2", "body", True, None, 1.0, 1.0), ("1->2", "title", True, None, 1.0, 1.0), ("2->3", "body", True, None, 0.0, None), ("3->4", "body", False, "kind", 1.0, 1.0))
    b = {r.boundary: r for r in P.best_boundary(pairs, ["boundary"], {"body": {"punct": 0.25, "style": 0.35}, "title": {"punct": 0.45, "style": 0.45}}, 0.8).collect()}
    assert (b["1->2"].pair, b["1->2"].linked, b["1->2"].reason) == ("body", True, None)
    assert (b["2->3"].linked, b["2->3"].reason, b["3->4"].reason) == (False, "below_threshold", "kind")
    truth = frame(spark, "boundary string, linked boolean, note string", ("1->2", True, None), ("2->3", False, "A Trap here"))
    assert {r.boundary: r.adjudication for r in P.adjudicated(frame(spark, "boundary string", ("1->2",), ("2->3",), ("3->4",)), truth, ["trap"]).collect()} == {"1->2": "linked", "2->3": "trap", "3->4": None}


def test_names_and_terms(spark):
    p = frame(spark, "page_number int, text string", (2, "Then Ada Lovelace met Charles Babbage."), (1, "Here Ada Lovelace wrote to Royal Society members."))
    got = [(r.source, r.n, r.first_page) for r in P.harvested_names(p, ["then", "here"], ["society"]).collect()]
    assert ("Charles Babbage", 1, 2) in got and all("Society" not in s for s, *_ in got)
    terms = frame(spark, "source string", ("ada  LOVELACE",), ("nobody",))
    assert {r.source: r.first_page for r in P.first_pages(terms, p).collect()} == {"ada  LOVELACE": 1, "nobody": None}
    assert {r.source: r.matches for r in P.match_counts(terms, p.withColumnRenamed("page_number", "id")).collect()} == {"ada  LOVELACE": 2, "nobody": 0}


def test_placeholders_both_ways(spark):
    runs = frame(spark, "p int, o int, text string, kind string", (1, 0, "Let ", "plain"), (1, 1, "x+1", "formula"), (1, 2, " be ", "plain"), (1, 3, "bold", "styled"), (2, 0, "E=mc", "formula"))
    s = {r.p: (r.sent, r.marks) for r in P.with_placeholders(runs, ["p"], "o").collect()}
    assert s == {1: ("Let {v1} be <s2>bold</s2>", [1, 2]), 2: ("E=mc", [1])}
    r = spark.range(1).select(P.parsed_reply(F.lit(s[1][0]), F.lit("Sei {V1} ein <S2>fettes</S2> {v9}!")).alias("x")).first().x
    assert [(q.kind, q.number, q.text) for q in r] == [("text", None, "Sei "), ("formula", 1, None), ("text", None, " ein "), ("styled", 2, "fettes"), ("text", None, " "), ("text", None, "!")]


def test_plans(spark):
    c = boxes(frame(spark, "i int, box array<double>, bounds array<double>", (1, [90.0, 0.0, 110.0, 10.0], [0.0, 0.0, 100.0, 100.0]), (2, [0.0, 0.0, 125.0, 10.0], [0.0, 0.0, 100.0, 100.0]), (3, [0.0, 0.0, 500.0, 10.0], [0.0, 0.0, 100.0, 100.0])), "box", "bounds")
    assert {r.i: (r.action, r.refusal) for r in P.contained_plans(c).collect()} == {1: ("slide", None), 2: ("shrink", None), 3: (None, "scale_floor")}
    s = boxes(frame(spark, "i int, box_a array<double>, box_b array<double>, page_box array<double>", (1, [0.0, 0.0, 50.0, 50.0], [45.0, 10.0, 65.0, 30.0], [0.0, 0.0, 200.0, 200.0]), (2, [0.0, 0.0, 10.0, 10.0], [1.0, 0.0, 11.0, 10.0], [0.0, 0.0, 200.0, 200.0])), "box_a", "box_b", "page_box")
    got = {r.i: r for r in P.separation_plans(s, coverage=0.1, margin=0.0).collect()}
    assert (got[1].moves, got[1].dx, got[1].dy, got[1].refusal) == ("b", 3.0, 0.0, None) and got[2].refusal == "alike"
    i = frame(spark, "kind string, action string, paragraph_refs array<string>", ("residue", "retry", ["a"]), ("residue", "move", ["a"]), ("x", "retry", ["a"]), ("residue", "retry", ["a", "b"]))
    assert [r.refusal for r in P.admitted(i, {"residue": ["retry"]}).collect()] == [None, "action", "unknown_kind", "not_one_paragraph"]


def test_drop_caps_scans_and_audits(spark):
    p = frame(spark, "doc int, debug_id string, page_number int, par_idx int, layout_label string, article_id int, opens boolean", (1, "a", 1, 0, "text", 7, False), (1, "b", 1, 1, "text", 7, False), (1, "c", 2, 0, "text", 7, True))
    r = frame(spark, "doc int, debug_id string, initial string, initial_size double, median_size double", (1, "a", "T", 30.0, 10.0), (1, "b", "T", 30.0, 10.0), (1, "c", "I", 11.0, 10.0))
    assert [x.debug_id for x in P.drop_caps(p, r, ["doc"]).collect()] == ["a"]
    s = frame(spark, "doc int, is_scanned boolean", *[(1, True)] * 4, (1, None), *[(2, True)] * 3, (2, False), (2, None), (3, None))
    assert {x.doc: x.scanned for x in P.scanned(s, ["doc"]).collect()} == {1: True, 2: False, 3: False}
    q = boxes(frame(spark, "p int, debug_id string, text string, box array<double>", (1, "a", "he llo", [0.0, 0.0, 50.0, 10.0])), "box")
    w = boxes(frame(spark, "p int, text string, box array<double>", (1, "hello", [0.0, 0.0, 30.0, 10.0]), (1, "far", [0.0, 90.0, 30.0, 99.0])), "box")
    assert P.fragments_audited(q, w, ["p"]).first().fault == "fracture"
    assert {x.field: x.rows for x in P.fields_set(p, ["opens", "article_id"]).collect()} == {"opens": 3, "article_id": 3}


def test_units_and_models(spark):
    chars, curves = frame(spark, "page_number int, render_order int, sub_order int, op string", (1, None, 1, "c"), (1, 5, 0, "d")), frame(spark, "page_number int, sub_order int, op string", (1, 0, "l"))
    u = P.render_units(chars=chars, curves=curves)
    assert [r.op for r in u.collect()] == ["d", "l", "c"] and P.streams_of(u, ["page_number"]).first().stream == "d\nl\nc"
    m = P.modelled(chars, lambda: lambda f: f[["page_number"]].assign(class_name="text"), "page_number int, class_name string")
    assert [r.class_name for r in m.collect()] == ["text", "text"]
    a = boxes(frame(spark, "p int, layout_id int, class_name string, conf double, box array<double>", (1, 1, "paragraph", 0.9, [0.0, 0.0, 10.0, 10.2])), "box")
    b = boxes(frame(spark, "p int, layout_id int, class_name string, conf double, box array<double>", (1, 1, "text", 0.8, [0.0, 0.0, 10.0, 10.0])), "box")
    assert {r.layout_id: r.box.y2 for r in P.hybrid_layout(a, b, ["p"]).collect()} == {1001: 10.2, 2001: 10.2}
    answers = iter(["no json", json.dumps({"a": 1})])
    assert P.judged(frame(spark, "prompt string", ("p",)), lambda: lambda p, it=["no json", '{"a": 1}']: it.pop(0), "prompt", "a int").first().reply.a == 1 and next(answers)
