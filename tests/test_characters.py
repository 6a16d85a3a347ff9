from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import characters as C


def chars(spark, text, xs, line=0):
    rows = [(1, i, c, float(x), float(x + 5), -12.0 * line, 10.0 - 12.0 * line) for i, (c, x) in enumerate(zip(text, xs, strict=True))]
    df = spark.createDataFrame(rows, "p int, i int, unicode string, x double, x2 double, y double, y2 double")
    return df.withColumn("box", G.box(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).drop("x", "x2", "y", "y2")


def test_spaces(spark):
    c = chars(spark, "abcdﬁ", [0, 7, 14, 29, 44])  # gaps 2, 2, 10, 10: the second smallest over 1 is 10
    assert C.texts(c, ["p"], "i").first().text == "abc d fi"
    assert C.texts(chars(spark, "ab", [0, 8]), ["p"], "i").first().text == "a b"
    assert C.texts(chars(spark, "ab", [0, 5.5]), ["p"], "i").first().text == "ab"
    two = chars(spark, "ab", [0, 5]).unionByName(chars(spark, "c", [0], 1).withColumn("i", F.lit(2)))
    assert C.texts(two, ["p"], "i").first().text == "ab c"
    assert [r.unicode for r in C.with_space_rows(two, ["p"], "i").orderBy("i", "sub_order").collect()] == ["a", "b", " ", "c"]


def test_paragraphs(spark):
    rows = [(1, 0, 7, None, "a", 50.0), (1, 1, 7, None, "b", 50.0), (1, 2, 8, None, " ", 50.0), (1, 3, 8, None, ".", 50.0), (1, 4, 8, None, "c", 50.0), (1, 5, 8, 3, "d", 50.0), (1, 6, 8, None, "e", 1.0)]
    df = spark.createDataFrame(rows, "page int, i int, layout_id int, xobj_id int, unicode string, area double")
    assert [r.par_idx for r in C.paragraphs_of(df, ["page"], ["i"]).orderBy("i").collect()] == [0, 0, 0, 0, 1, 2, 2]


def test_formulas(spark):
    df = spark.createDataFrame([("+", True), ("a", True), ("a", False), ("α", True), ("7", True), (" ", True), ("(cid:3)", True), ("", True)], "c string, known boolean")
    assert [r.f for r in df.select(C.begins_formula(F.col("c"), F.col("known")).alias("f")).collect()] == [True, False, True, True, True, False, True, False]
    f = spark.createDataFrame([(1, 0, 0, None, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, None, 11.0, 1.0, 15.0, 9.0), (1, 2, 0, None, 60.0, 0.0, 70.0, 10.0), (1, 4, 1, None, 0.0, 0.0, 10.0, 10.0)], "p int, pos int, line_id int, layout_id int, x double, y double, x2 double, y2 double")
    assert sorted(r.merged for r in C.merged_formulas(f, ["p"], ["pos"]).collect()) == [[0, 1], [2], [4]]


def test_profiles_initials_and_scales(spark):
    rows = spark.createDataFrame([("zh_CN",), ("zho",), (None,), ("en-GB",)], "language string")
    prefixes = spark.createDataFrame([("zh", "cjk"), ("en", "latin"), ("en-gb", "british")], "prefix string, profile string")
    assert {r.language: r.profile for r in C.language_profiles(rows, prefixes, "default").collect()} == {"zh_CN": "cjk", "zho": "default", None: "default", "en-GB": "british"}
    p = spark.createDataFrame([("T he end", "T"), ("A  Word", "A")], "text string, initial string").withColumns({"box": G.box(0, 0, 9, 20), "body_box": G.box(2, 5, 9, 18)})
    assert {(r.text, r.box.y) for r in C.flattened_initials(p).collect()} == {("The end", 5.0), ("A  Word", 0.0)}
    s = spark.createDataFrame([(100.0, 100.0), (100.0, 72.0), (100.0, 10.0)], "width double, room double")
    assert [r.scale for r in C.single_line_scale(s).collect()] == [1.0, 0.7, None]


def test_rollback(spark):
    b, a = (spark.createDataFrame([(1, v), (2, v)], "page int, v string") for v in ("old", "new"))
    none, one = spark.createDataFrame([], "page int, kind string"), spark.createDataFrame([(2, "overlap")], "page int, kind string")
    assert {r.page: r.v for r in C.rolled_back(b, a, none, one, ["page"]).collect()} == {1: "new", 2: "old"}


def test_repeats_and_lines(spark):
    r = spark.createDataFrame([(["Big ", "News", "BIG", " news"],), (["a", "b"],), (["a"],)], "r array<string>").select(C.repeats_at(F.col("r")).alias("k")).collect()
    assert [x.k for x in r] == [2, None, None]
    c = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 10.0), (1, 1, 6.0, 1.0, 11.0, 11.0), (1, 2, 90.0, 0.0, 95.0, 10.0), (1, 3, 0.0, 40.0, 5.0, 50.0)], "p int, i int, x double, y double, x2 double, y2 double")
    assert [x.line for x in C.clustered(c, ["p"], ["i"]).orderBy("i").collect()] == [0, 0, 1, 2]
    assert sorted(x.members for x in C.joined_lines(c, ["p"], ["i"]).collect()) == [[0, 1], [2], [3]]
