import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import records as R
from quire.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_overlaps(spark):
    a, b = G.box(0, 0, 10, 10), G.box(5, 5, 25, 10)
    r = one(spark, iou=G.iou(a, b), first=G.overlap_over_first(a, b), cover=G.coverage(a, b), y1=G.y_overlap_over_first(a, b), y2=G.y_overlap_over_smaller(a, b), x=G.x_overlap_over_narrower(a, b), same=G.same_measure(a, b, 0.25), flat=G.y_overlap_over_smaller(a, G.box(0, 3, 1, 3)), point=G.iou(G.box(1, 1, 1, 1), a))
    assert (r.iou, r.first, r.cover) == (25 / 175, 0.25, 0.25) and (r.y1, r.y2, r.x, r.same) == (0.5, 1.0, 0.5, True)
    assert r.flat is None and r.point == 0.0


def test_moves(spark):
    page = G.box(0, 0, 100, 50)
    r = one(spark, over=G.overflow(G.box(-5, 10, 104, 60), page), worst=G.worst_overflow(G.overflow(G.box(-5, 10, 104, 60), page), page), fine=G.worst_overflow(G.overflow(G.box(1, 1, 2, 2), page), page), fit=G.fit(G.box(90, 0, 290, 50), page), away=G.escape_distances(G.box(0, 0, 10, 10), G.box(5, 0, 15, 10), 0.0), unit=G.on_unit_page(G.box(10, 10, 20, 20), page), none=G.on_unit_page(G.box(1, 1, 2, 2), G.box(0, 0, 0, 5)))
    assert r.over == Row(left=5.0, bottom=0.0, right=4.0, top=10.0) and r.worst == Row(side="top", points=10.0, ratio=0.2) and r.fine is None
    assert r.fit.scale == 0.5 and r.fit.dx == -90.0
    assert (r.away.left, r.away.right, r.away.down, r.away.up) == (5.0, 15.0, 10.0, 10.0)
    assert r.unit == Row(x=0.1, y=0.2, x2=0.2, y2=0.4) and r.none is None


def test_matrices(spark):
    turn = G.matrix(0.0, 2.0, -2.0, 0.0, 5.0, 6.0)
    r = one(spark, d=G.decompose(turn), m=G.multiply(G.matrix(1, 0, 0, 1, 1, 0), turn), s=G.moved(turn, F.lit(1.0), F.lit(1.0), F.lit(0.5)))
    assert (r.d.dx, r.d.rotation, r.d.scale_x, r.d.scale_y, r.d.shear) == (5.0, 90.0, 2.0, 2.0, 0.0)
    assert (r.m.e, r.m.f) == (5.0, 8.0) and (r.s.b, r.s.e) == (1.0, 3.5)


def test_signals(spark):
    w = {"a": 0.5, "b": 0.5, "c": -0.2}
    null = F.lit(None).cast("double")
    r = one(spark, all=G.combined({"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(1.0)}, w), some=G.combined({"a": F.lit(1.0), "b": null, "c": null}, w), none=G.combined({"a": null, "b": null, "c": null}, w), log=G.clipped_log(F.lit(0.5)), mean=G.mean_of(F.lit(1.0), null), shares=G.shares(F.array(F.lit(1.0), F.lit(3.0))), even=G.half_even(F.lit(2.5), 0))
    assert r.all == pytest.approx(0.3) and r.some == 1.0 and r.none is None and r.log == pytest.approx(math.log(2)) and r.mean == 1.0
    assert r.shares == [0.25, 0.75] and r.even == 2.0


def test_text_predicates(spark):
    r = one(spark, cid=T.mostly_cid(F.array(*[F.lit("(cid:7)")] * 5)), some=T.mostly_cid(F.array(*[F.lit("(cid:7)")] * 4, F.lit("a"))), num=T.pure_numeric(F.lit(" -3.5 ")), name=T.name_or_label(F.lit("Anna Klein")), label=T.name_or_label(F.lit("fig. 1")), fence=T.unfenced(F.lit("```json\n{}\n```")), end=T.ends_sentence(F.lit('He said "yes."  ')), open=T.open_end(F.lit("and then")), nothing=T.open_end(F.lit('")')), family=T.font_family(F.lit("ABCDEF+Times-BoldItalic")), cjk=T.cjk(F.lit("漢")), text=T.rendered("{a} and {b}", {"a": F.lit("x"), "b": F.lit(2)}))
    assert (r.cid, r.some, r.num) == (True, False, True) and (r.name, r.label) == ("name_shaped", "label_shaped")
    assert (r.fence, r.end, r.open, r.nothing, r.family, r.cjk, r.text) == ("{}", True, 1.0, None, "Times", True, "x and 2")
    with pytest.raises(ValueError, match="variables"):
        T.rendered("{a}", {"b": F.lit(1)})


def test_text_functions(spark):
    s = "Dr. Who came. He (he) left! \"Why?\" 终于。完了"
    r = one(spark, sents=T.sentences(F.lit(s)), fold=T.folded_parens(F.lit("CERN (CERN) and ＡＢ（AB） but PS (LHC)")), esc=T.unescaped(T.escaped(F.lit("a\x00b\\u"))), sim=T.similarity(F.lit("abcd"), F.lit("ab cd")), f1=T.band_fault(F.lit("ab c"), F.lit("abc")), f2=T.band_fault(F.lit("cab"), F.lit("abc")), f3=T.band_fault(F.lit("abcabc"), F.lit("abc")), f4=T.band_fault(F.lit("ab"), F.lit("abc")), terms=T.capitalised_terms(F.lit("The Bank of England rose. Prices soon in London fell.")), nfkc=T.nfkc(F.lit("ﬁ")))
    assert "".join(r.sents) == s and r.sents[0] == "Dr. Who came. " and len(r.sents) == 5
    assert r.fold == "CERN and ＡＢ but PS (LHC)" and r.esc == "a\x00b\\u" and r.sim == 1.0 and r.nfkc == "fi"
    assert (r.f1, r.f2, r.f3, r.f4) == ("fracture", "order", "duplicate", "dropped")
    assert r.terms == ["The Bank of England", "London"]


def test_page_ranges(spark):
    for text, pages in (("1-,2", [1, 2, 9]), ("-3", [1, 3]), ("2,4-5", [2, 4, 5]), ("", []), (None, [1, 9])):
        r = T.page_ranges(F.lit(text).cast("string"))
        got = [p for p in (1, 2, 3, 4, 5, 9) if one(spark, x=T.in_ranges(F.lit(p), r)).x]
        want = {"1-,2": [1, 2, 3, 4, 5, 9], "-3": [1, 2, 3], "2,4-5": [2, 4, 5], "": [], None: [1, 2, 3, 4, 5, 9]}[text]
        assert got == want, text


def test_records(spark):
    reply = lambda s: R.strict_reply(F.lit(s), {"action": "string", "n": "double"}, {"n": (0, 1)}, {"action": ["go"]})
    r = one(spark, ok=reply('{"action": "go", "n": 0.5}'), extra=reply('{"action": "go", "n": 0.5, "x": 1}'), miss=reply('{"action": "go"}'), word=reply('{"action": "no", "n": 0.5}'), far=reply('{"action": "go", "n": 5}'), junk=reply("hello"), pairs=R.term_pairs(F.lit('[{"src": " a ", "tgt": "b"}, {"src": "", "tgt": "x"}]')), bad=R.term_pairs(F.lit("no")), canon=R.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))
    assert r.ok.violation is None and r.ok.value.n == 0.5
    assert [x.violation for x in (r.extra, r.miss, r.word, r.far, r.junk)] == ["extra_field", "missing:n", "vocabulary:action", "bounds:n", "not_json"]
    assert r.pairs == [Row(src="a", tgt="b")] and r.bad == [] and r.canon == '{"a":2,"b":1}'
