import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import passes
from quire.sources import pdf


def test_round_trip_boxes_and_streams():
    data = pdf.document([(200, 300, b"BT (a) Tj ET"), (612.5, 792, b"q Q")])
    assert [(n, m, b, e) for n, m, _, _, b, _, _, e in pdf.read(data)] == [(0, [0, 0, 200, 300], b"BT (a) Tj ET", None), (1, [0, 0, 612.5, 792], b"q Q", None)]
    assert [r[4] for r in pdf.read(data, geometry=True)] == [None, None]
    broken = data.replace(b"xref", b"xxxx").replace(b"/Root 1 0 R", b"/Root 99 0 R")  # found by the catalog's type
    assert len(pdf.read(broken)) == 2
    assert len(pdf.read(data.replace(b"/Kids [4 0 R 6 0 R]", b"/Kids [2 0 R 98 0 R]"))) == 2  # a circle and a gap: all page objects
    again = data + b"\n4 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] >>\nendobj\n"
    assert pdf.read(again)[0][1] == [0, 0, 9, 9]  # a later definition replaces an earlier one


def test_object_streams_filters_inheritance_and_fonts():
    inner = b"3 0 4 60 " + b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R 7 0 R] >>".ljust(60) + b"<< /BaseFont /AB#43 /ToUnicode 8 0 R >>"
    packed = zlib.compress(inner)
    rows = b"\x02ab\x02\x01\x01"  # PNG's Up: second row adds to the first
    up = zlib.compress(rows)
    s = lambda n, head, body: b"%d 0 obj\n<< %s /Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (n, head, len(body), body)
    data = b"%PDF-1.5\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Kids[3 0 R]/MediaBox[0 0 50 60]/Rotate 90/Resources<</Font<</F1 4 0 R>>/XObject<</X1 9 0 R>> >> >>\nendobj\n"
    data += s(5, b"/Type /ObjStm /N 2 /First 9 /Filter /FlateDecode", packed) + s(6, b"/Filter /ASCIIHexDecode", b"71 20 51>") + s(7, b"/Filter [/FlateDecode] /DecodeParms [<< /Predictor 12 /Columns 2 >>]", up) + s(8, b"", b"map") + s(9, b"/Subtype /Form", b"form")
    ((number, media, crop, rotate, body, forms, fonts, why),) = pdf.read(data)
    assert (number, media, crop, rotate, body, why) == (0, [0, 0, 50, 60], [0, 0, 50, 60], 90, b"q Q\nabbc", None)
    assert forms == [{"name": "/X1", "content": b"form"}] and fonts == [{"name": "/F1", "base_font": "ABC", "to_unicode": b"map"}]


def test_refusals_and_edges(spark):
    good = pdf.document([(10, 10, b"x" * 5000)])
    rows = [(1, good), (2, None), (3, b"junk"), (4, good.replace(b"/Root", b"/Encrypt 1 0 R /Root")), (5, b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj"), (1, good), (6, good[:200]), (7, b"%PDF-1.4\n1 0 obj " + b"[" * 5000)]
    got = pdf.pages_of(spark.createDataFrame(rows, "f int, content binary"), ["f"]).collect()
    assert sorted((r.f, r.corrupt is None) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False)]
    assert "encrypted" in next(r.corrupt for r in got if r.f == 4)
    few = pdf.pages_of(spark.createDataFrame(rows[:1], "f int, content binary"), ["f"], most_bytes=100).collect()
    assert "more than 100" in few[0].corrupt and few[0].page_number is None
    assert pdf.pages_of(spark.createDataFrame([], "f int, content binary"), ["f"]).count() == 0


def test_side_by_side(spark):
    o = spark.createDataFrame([("d", 0, 100.0, 50.0, "A"), ("d", 1, 100.0, 50.0, "B")], "doc string, page_number int, width double, height double, stream string")
    got = {r.page_number: r for r in pdf.dual_pages(o, o.where("page_number = 0").withColumn("stream", F.lit("T")), ["doc"], True).collect()}
    assert got[0].width == 200 and got[1].width == 200 and "T" in got[0].stream and "100.0 0 cm" in got[0].stream and "B" in got[1].stream


def test_ssim():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (20, 30)).astype(np.uint8)
    assert passes.ssim(a, a) == pytest.approx(1) and passes.ssim(a, 255 - a) < 0 and passes.ssim(a, a[::-1]) < 0.3
    n = 7  # one window by hand
    x, y = a[:n, :n].astype(float), a[5 : 5 + n, 5 : 5 + n].astype(float)
    c1, c2 = 2.55**2, 7.65**2
    cov = ((x - x.mean()) * (y - y.mean())).sum() / (n * n - 1)
    want = (2 * x.mean() * y.mean() + c1) * (2 * cov + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var(ddof=1) + y.var(ddof=1) + c2))
    assert passes.ssim(x, y) == pytest.approx(want)


def test_clients_are_asked_again_and_once(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("bad",), (None,), ("known",)], "prompt string")

    def client():
        seen = []

        def ask(p):
            seen.append(p)
            return '{"n": 7}' if p == "a" and len(seen) > 1 else "no"

        return ask

    from quire.functions.records import cache_digest

    cache = spark.createDataFrame([("known",), ("known",)], "p string").select(cache_digest(F.col("p")).alias("digest"), F.lit('{"n": 1}').alias("reply"))
    answers, fresh = passes.cached_answers(asked.coalesce(1), cache, client, "prompt", "n int", lambda df: df, attempts=3)
    assert sorted(((r.prompt or ""), r.reply and r.reply.n) for r in answers.collect()) == [("", None), ("a", 7), ("a", 7), ("bad", None), ("known", 1)]
    assert fresh.count() == 1
