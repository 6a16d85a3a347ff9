import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import aggregates as A
from quire.operators import folds, services
from quire.operators import joins as J
from quire.operators import windows as W


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_elements_are_assigned_once(spark):
    formulas = frame(spark, "p int, formula_idx int, box array<double>, xobj_id int", (1, 1, [0.0, 0.0, 10.0, 10.0], None), (1, 2, [0.0, 0.0, 12.0, 12.0], None))
    elements = frame(spark, "p int, e int, box array<double>, xobj_id int", (1, 1, [1.0, 1.0, 2.0, 2.0], None), (1, 2, [-1.0, 1.0, 1.0, 2.0], None), (1, 3, [50.0, 1.0, 60.0, 2.0], None))
    as_box = lambda df: df.withColumn("box", G.box(F.col("box")[0], F.col("box")[1], F.col("box")[2], F.col("box")[3]))
    got = {r.e: r for r in J.assigned_elements(as_box(elements), as_box(formulas), ["p"], ["e"]).collect()}
    assert set(got) == {1, 2} and (got[1].match_type, got[1].formula_idx) == ("exact", 1) and got[2].match_type == "contained"


def test_standing_and_free_space(spark):
    rows = frame(spark, "p int, idx int, x double, y double, x2 double, y2 double", (1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 5.0, 0.0, 15.0, 10.0), (1, 3, 30.0, 2.0, 40.0, 8.0))
    b = rows.select("p", "idx", G.box(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("box"), G.box(0, 0, 100, 100).alias("crop"))
    on = {r.idx: r.on for r in J.standing_on(b, b, ["p"], "idx", 0.2).collect()}
    assert on == {1: [2], 2: [1], 3: []}
    free = {r.idx: r.right_limit for r in J.nearest_free(b, b, ["p"], "idx").collect()}
    assert free == {1: 30.0, 2: 30.0, 3: 90.0}


def test_fonts_and_scopes(spark):
    fonts = frame(spark, "font_id string, bold boolean, italic boolean, priority int", ("a", False, False, 1), ("b", False, False, 2))
    glyphs = frame(spark, "font_id string, unicode string", ("a", "x"), ("b", "x"), ("b", "y"))
    chars = frame(spark, "unicode string, bold boolean, italic boolean", ("x", False, False), ("y", False, False), ("z", False, False))
    assert {r.unicode: r.mapped_font for r in J.first_font(chars, fonts, glyphs).collect()} == {"x": "a", "y": "b", "z": None}
    rows, own = frame(spark, "scope int, font_id string", (1, "f"), (1, "g")), frame(spark, "scope int, font_id string, font string", (0, "f", "page"), (0, "g", "page"), (1, "g", "own"))
    assert {r.font_id: r.font for r in J.scoped(rows, own).collect()} == {"f": "page", "g": "own"}


def test_labels_by_kind_and_policy(spark):
    v = frame(spark, "file string, page int, kind string", ("f", 1, "ad"), ("f", 2, "toc"), ("f", 3, "odd"))
    labels = frame(spark, "file string, page int, accepted array<string>", ("f", 1, ["ad"]), ("f", 2, ["index"]), ("f", 3, ["ad"]))
    policies = frame(spark, "kind string, policy string", ("ad", "skip"), ("toc", "lists"), ("index", "lists"))
    assert {r.page: (r.hit, r.policy_hit) for r in J.scored_labels(v, labels, policies).collect()} == {1: (True, True), 2: (False, True), 3: (False, False)}


def test_levels_deltas_and_agreement(spark):
    null = F.lit(None).cast("boolean")
    r = spark.range(1).select(A.all_levels(F.lit(True), null).alias("a"), A.all_levels(null, null).alias("b"), A.all_levels(F.lit(True), F.lit(False)).alias("c"), A.relative_delta(F.lit(0), F.lit(0)).alias("d"), A.relative_delta(F.lit(2), F.lit(4)).alias("e"), A.relative_delta(F.lit(None).cast("int"), F.lit(4)).alias("f")).first()
    assert tuple(r) == (True, None, False, 0.0, 0.5, None)
    s = frame(spark, "k int, font string, size double", (1, "a", 10.0), (1, "a", 10.01), (2, "a", 10.0), (2, "b", 12.0))
    assert {r.k: (r.font, r.size) for r in s.groupBy("k").agg(A.agreed("font").alias("font"), A.agreed("size", 0.02).alias("size")).collect()} == {1: ("a", 10.0), 2: (None, None)}


def test_line_spacing_and_votes(spark):
    t = frame(spark, "p int, i int, top double", (1, 0, 100.0), (1, 1, 88.0), (1, 2, 74.0), (1, 3, 62.0), (2, 0, 5.0))
    assert {r.p: r.spacing for r in A.line_spacing(t, ["p"], "i", "top").collect()} == {1: 12.0, 2: 10.0}
    v = frame(spark, "k string, v string, seq int", ("a", "x", 2), ("a", "y", 1), ("b", "z", 1), ("b", None, 0))
    assert {r.k: r.v for r in A.voted(v, ["k"], "v", "seq").collect()} == {"a": "y", "b": "z"}


def test_midranks_and_islands(spark):
    t = frame(spark, "g int, v int", (1, 1), (1, 2), (1, 2), (1, 5), (1, None))
    assert sorted((r.v or 0, r.r) for r in W.midranks(t, ["g"], "v", "r").collect() if r.v) == [(1, 0.125), (2, 0.5), (2, 0.5), (5, 0.875)]
    p = frame(spark, "d int, i int, text string, layout_id int, xobj_id int", (1, 0, "a", 1, None), (1, 1, "12", 1, None), (1, 2, "b", 1, None), (1, 3, "c", 2, None))
    assert [r.merged for r in W.line_numbers_merged(p, ["d"], ["i"]).orderBy("i").collect()] == [1, 1, 1, 2]


def test_chains_and_articles(spark):
    b = frame(spark, "doc int, tail_page int, tail_par int, head_page int, head_par int, linked boolean", (1, 1, 9, 2, 0, True), (1, 2, 0, 3, 0, True), (1, 3, 5, 4, 0, True), (1, 4, 1, 5, 0, False))
    got = W.chained(b, ["doc"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.chain_id, []).append((r.chain_index, r.page))
    assert sorted(sorted(v) for v in by.values()) == [[(0, 1), (1, 2), (2, 3)], [(0, 3), (1, 4)]]
    a = frame(spark, "doc int, article int, chain_id string", (1, 1, "c"), (1, 2, "c"), (1, 3, None), (1, 4, "e"), (1, 2, "e"))
    assert {r.article: r.merged for r in folds.components_of_pages(a, ["doc"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_folds(spark):
    t = frame(spark, "d int, i int, tokens int", *[(1, i, n) for i, n in enumerate([100, 90, 50, 10, 10, 10, 10, 10, 10, 10])])
    assert [r.batch for r in folds.batched(t, ["d"], ["i"], "tokens").orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 1, 2]
    x = frame(spark, "d int, i int, v double", *[(1, i, v) for i, v in enumerate([0.0, 4.0, 8.0, 12.0, 30.0])])
    assert [r.band for r in folds.seeded_bands(x, ["d"], ["i"], "v", 9.0).orderBy("i").collect()] == [0, 0, 0, 1, 2]
    s = frame(spark, "d int, i int, font_id string, font_size double", (1, 0, "a", 10.0), (1, 1, "a", 10.015), (1, 2, "a", 10.03), (1, 3, "b", 10.0))
    assert [r.run for r in folds.style_runs(s, ["d"], ["i"]).orderBy("i").collect()] == [0, 0, 1, 2]
    y = frame(spark, "d int, i int, x double, x2 double, y double, y2 double, xobj_id int", (1, 0, 0.0, 10.0, 8.0, 20.0, 0), (1, 1, 0.0, 10.0, 0.0, 10.0, 0))
    assert [(r.y, r.y2) for r in folds.separated(y, ["d"], ["i"]).orderBy("i").collect()] == [(10.0, 20.0), (0.0, 8.0)]
    u = frame(spark, "d int, i int, text string, barrier boolean", (1, 0, "A long beginning that is more than forty characters", False), (1, 1, "end.", False), (1, 2, "New", False), (1, 3, "wall", True), (1, 4, "x", False))
    assert [r.unit for r in folds.stitched(u, ["d"], ["i"]).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    b = frame(spark, "p int, row int, col int", (1, 0, 0), (1, 1, 1), (1, 5, 5), (2, 0, 0))
    assert {r.p: r.regions for r in folds.region_count(b, ["p"]).collect()} == {1: 2, 2: 1}


def test_texts_and_redistribution(spark):
    r = spark.range(1).select(folds.split_at_commas(F.lit("a,b(c,d),e),f")).alias("p"), folds.joined_members(F.array(*map(F.lit, ["trans-", "lation goes", " ", "on"]))).alias("j")).first()
    assert r.p == ["a", "b(c,d)", "e)", "f"] and r.j == "translation goes on"
    c = frame(spark, "chain_id int, translation string, lengths array<int>", (1, "One sentence. Two sentences here.", [14, 19]), (2, "ab", [5, 5, 5]), (3, "", [1, 1]))
    got = {}
    for q in folds.redistributed(c).orderBy("chain_index").collect():
        got.setdefault(q.chain_id, []).append(q.text)
    assert got[1] == ["One sentence. ", "Two sentences here."] and "".join(got[2]) == "ab" and len(got[2]) == 3 and got[3] == ["", ""]


def test_matching_and_peeling(spark):
    a, b = frame(spark, "p int, idx int, area double", (1, 0, 10.0), (1, 1, 9.0)), frame(spark, "p int, idx int, area double", (1, 0, 9.0), (1, 1, 2.0))
    assert [(r.source_idx, r.produced_idx) for r in folds.matched_areas(a, b, ["p"]).collect()] == [(0, 0)]
    c = frame(spark, "region int, term string, paragraph int, candidate string", *[(1, "t", p, w) for p, ws in {1: ["ab", "abc"], 2: ["ab", "abc"], 3: ["xy"], 4: ["xy"], 5: ["q"]}.items() for w in ws])
    assert [(r.rendering, r.size) for r in folds.peeled_renderings(c, ["region"]).collect()] == [("abc", 2), ("xy", 2)]


def test_cache(spark):
    cache = frame(spark, "id long, engine string, params string, text string, translation string", (1, "e", "p", "a", "old"), (2, "e", "p", "b", "x"))
    new = frame(spark, "engine string, params string, text string, translation string, seq long", ("e", "p", "a", "new", 2), ("e", "p", "a", "older", 1))
    up = services.upserted(cache, new)
    assert {r.text: r.translation for r in up.collect()} == {"a": "new", "b": "x"}
    req = frame(spark, "engine string, params string, text string", ("e", "p", "a"), ("e", "p", "c"))
    assert [r.text for r in services.misses(req, cache).collect()] == ["c"]
    assert {r.text: r.translation for r in services.hits(req, up).collect()} == {"a": "new", "c": None}
    assert sorted(r.translation for r in services.answered(req, lambda: str.upper, 1000.0).collect()) == ["A", "C"]


def test_plans_repairs_and_replay(spark):
    m = frame(spark, "chain_id int, chain_index int, text string, tokens int", (1, 0, "a", 1), (1, 1, "b", 1), (2, 0, "x", 1), (3, 0, "y", 1), (3, 1, " ", 1), (4, 0, "q", 900), (4, 1, "r", 900))
    assert {r.chain_id: r.refusal for r in services.planned_chains(m, 1000).collect()} == {1: None, 2: "single", 3: "blank_member", 4: "too_long"}
    r = spark.range(1).select(services.improved(F.array(F.lit(3), F.lit(2)), F.array(F.lit(3), F.lit(1))).alias("a"), services.improved(F.array(F.lit(3)), F.array(F.lit(3))).alias("b")).first()
    assert tuple(r) == (True, False)
    rows = frame(spark, "id int, v int", (1, 5), (2, 1))
    detect = lambda d: d.where("v > 2").select("id", F.lit("big").alias("kind"))
    fixed, history = services.repaired(rows, detect, lambda d, i: d.withColumn("v", F.col("v") - 2), lambda d, k: spark.createDataFrame(d.collect(), d.schema))
    assert history == [{"big": 1}] and {r.id: r.v for r in fixed.collect()} == {1: 5, 2: 1}  # 3 is still too big: undone
    fixed, history = services.repaired(rows, detect, lambda d, i: d.withColumn("v", F.col("v") - 4), lambda d, k: spark.createDataFrame(d.collect(), d.schema))
    assert history == [{"big": 1}, {}] and {r.id: r.v for r in fixed.collect()} == {1: 1, 2: -3}
    log = frame(spark, "execution_id string, sequence long, type string, payload string", ("e", 3, "a", ""), ("e", 4, "b", ""))
    assert [x.sequence for x in services.replayed(log, "e", 2).collect()] == [3, 4]
    with pytest.raises(Exception, match="evicted"):
        services.replayed(log, "e", 1).collect()
    assert services.page_chunks(7, 3) == [(0, 2), (3, 5), (6, 6)]


def test_scopes_that_span_batches(spark):
    rows = frame(spark, "p int, q string, i int, v double", *[(p, q, i, float(i)) for p in (1, None, 2) for q in ("a", None) for i in range(7)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = folds._numbered(rows, ["p", "q"], ["i"], "n", lambda g: [10 * len(g) + k for k in range(len(g))]).collect()
        assert len(got) == 42 and all(r.n == 70 + r.i for r in got)
        sums = folds.folded(rows, ["p", "q"], ["i"], lambda g: g.head(1).assign(v=g["v"].sum())[["v"]], "v double").collect()
        assert [r.v for r in sums] == [21.0] * 6
        empty = rows.where("false")
        assert folds._numbered(empty, ["p"], ["i"], "n", lambda g: []).count() == folds.folded(empty, ["p"], ["i"], lambda g: g[["v"]], "v double").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
