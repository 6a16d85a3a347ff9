import json

import pytest
from pyspark.sql import functions as F

from quire.sources import content as C
from quire.sources import files as S
from quire.streaming import events as E


def test_tree_xml(spark, tmp_path):
    (tmp_path / "il.xml").write_text('<document totalPages="2"><page pageNumber="0" pageKind="prose"><pdfParagraph unicode="Hello" debug_id="a1" layout_label="text"><box x="1" y="2" x2="3" y2="4"/></pdfParagraph></page><page pageNumber="1"></page></document>')
    pages = S.tree_pages(spark, f"{tmp_path}/il.xml")
    assert S.checked_pages(pages, 2).count() == 2
    with pytest.raises(Exception, match="expected 3 pages"):
        S.checked_pages(pages, 3).count()
    (p,) = S.paragraphs_of(pages).collect()
    assert (p.page_number, p.par_idx, p.text, p.debug_id, p.box.x2) == (0, 0, "Hello", "a1", 3.0)


def test_glossary_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('source,target,tgt_lng\n"a,a","b ""c""",\nx,y,zh-CN\nz,w,fr\n')
    got = {r.source: r.target for r in S.glossary(spark, f"{tmp_path}/g.csv", "zh_cn").collect()}
    assert got == {"a,a": 'b "c"', "x": "y"}
    S.write_glossary(S.glossary(spark, f"{tmp_path}/g.csv"), f"{tmp_path}/out")
    assert S.glossary(spark, f"{tmp_path}/out").count() == 3
    (tmp_path / "bad.csv").write_text("source\nx\n")
    with pytest.raises(ValueError, match="target"):
        S.glossary(spark, f"{tmp_path}/bad.csv")


def test_labels_boundaries_and_faults(spark, tmp_path):
    text = spark.createDataFrame([(json.dumps({"f.pdf": {"1": "ad", "2": ["toc", "index"]}}),)], "value string")
    labels = S.page_labels(text)
    assert {r.page: r.accepted for r in labels.collect()} == {1: ["ad"], 2: ["toc", "index"]}
    pages = spark.createDataFrame([("f.pdf", 1)], "file string, page int")
    assert {(r.page, r.fault) for r in S.unknown_labels(labels, ["ad", "toc"], pages).collect()} == {(2, "type:index"), (2, "page")}
    r = spark.createDataFrame([("3->4",), ("x->4",)], "k string").select(S.boundary(F.col("k")).alias("b")).collect()
    assert (r[0].b.tail_page, r[0].b.head_page, r[1].b.tail_page) == (3, 4, None)
    entries = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", " ")], "path string, publication string")
    files, manifest = spark.createDataFrame([("a", "1"), ("c", "2")], "path string, sha256 string"), spark.createDataFrame([("a", "0")], "path string, sha256 string")
    assert {(r.path, r.fault) for r in S.registry_faults(entries, files, manifest).collect()} == {("a", "duplicate"), ("b", "no_publication"), ("b", "missing"), ("c", "unlisted"), ("a", "changed")}
    assert S.sidecar(spark, f"{tmp_path}/none.json", "a int").count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(0, "x", 1, 5), (1, "y<", 2, 7)], "page_number int, t string, part int, n int")
    assert [r.side for r in S.interleaved(a, a).collect()] == [0, 1, 0, 1]
    assert S.side_by_side(a, a.where("page_number = 0")).collect()[1].translated is None
    parts = spark.createDataFrame([(0, 0, 5), (1, 0, 6), (0, 1, 7)], "page_number int, part int, tokens int")
    pages, totals = S.merged_parts(parts, ["tokens"])
    assert sorted(r.page_number for r in pages.collect()) == [0, 1, 2] and totals.first().tokens == 18
    assert S.markdown_table(a.select("page_number", "t"), ["page_number"]).first().value.splitlines()[-1] == "| 1 | y< |"
    assert [r.value for r in S.html_rows(a, ["t"]).collect()][1] == "<tr><td>y&lt;</td></tr>"
    path = S.write_checkpoint(a, str(tmp_path), 3, "styles")
    assert path.endswith("03_styles") and spark.read.parquet(path).count() == 2 and S.write_checkpoint(a, str(tmp_path), 4, "x", False) is None


def test_content_streams(spark):
    data = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 7 Td (AB) Tj [(A) -500 (B)] TJ T* <41> Tj ET Q BT /F1 8 Tf (B) Tj ET junk ) >> 1 0 bad"
    ops = C.operations_of(spark.createDataFrame([(1, bytearray(data))], "page int, content binary"), ["page"])
    runs = C.text_runs(ops, ["page"]).orderBy("run", "part").collect()
    assert [(r.run, r.codes, r.adjust) for r in runs] == [(0, "4142", 0.0), (1, "41", 0.0), (1, None, -500.0), (1, "42", 0.0), (2, "41", 0.0), (3, "42", 0.0)]
    assert (runs[0].e, runs[0].f, runs[0].a, runs[-1].font_size, runs[-1].e) == (20.0, 34.0, 2.0, 8.0, 0.0)
    widths = spark.createDataFrame([("/F1", 65, "A", 500.0, 800.0, -200.0), ("/F1", 66, "B", 600.0, 800.0, -200.0)], "font string, code int, unicode string, width double, ascent double, descent double")
    g = C.glyphs(C.text_runs(ops, ["page"]), widths, ["page"]).orderBy("run", "part", "pos").collect()
    assert [r.unicode for r in g] == ["A", "B", "A", "B", "A", "B"]
    assert (g[0].box.x, g[0].box.x2, g[1].box.x) == (20.0, 30.0, 30.0)
    assert g[3].box.x == pytest.approx(20 + 2 * (5 + 5)) and not g[0].vertical


def test_cmap():
    assert C.cmap(b"2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange") == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "y"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(e, i, "finish" if i == 7 else "step", str(i)) for e in ("a", "b") for i in range(10)]
    src = spark.createDataFrame(rows, "execution_id string, ts long, type string, payload string")
    src.where("ts < 4").write.parquet(f"{tmp_path}/in/1")
    src.where("ts >= 4").write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in")
    q = E.sequenced(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in E.sequenced_batch(src).collect()} and len(got) == 16
    log = spark.read.parquet(f"{tmp_path}/out")
    assert E.bounded(log, 3).count() == 6 and E.unfinished(log).count() == 0 and E.unfinished(log.where("sequence < 5")).count() == 2


def test_progress(spark):
    s = spark.createDataFrame([("e", "a", 3.0, 10, 10), ("e", "b", 1.0, 1, 2)], "execution_id string, stage string, weight double, done int, total int")
    assert E.progress(s).first().progress == pytest.approx(87.5)


def test_nested_forms(spark):
    ops = spark.createDataFrame([(1, 0, "q", "[]"), (1, 1, "Do", '["/F"]'), (1, 2, "Do", '["/Image"]')], "page int, seq long, operator string, operands string")
    forms = spark.createDataFrame([(1, "/F", 0, "a", "[]"), (1, "/F", 1, "Do", '["/G"]'), (1, "/G", 0, "b", "[]"), (1, "/G", 1, "Do", '["/F"]')], "page int, name string, seq long, operator string, operands string")
    got = [(r.operator, r.path) for r in C.with_forms(ops, forms, ["page"]).orderBy("path").collect()]
    assert got == [("q", [0]), ("a", [1, 0]), ("b", [1, 1, 0]), ("Do", [1, 1, 1]), ("Do", [2])]
