"""Page content streams: lexer, text interpreter, glyph rows and ToUnicode maps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G

TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?![^\s()<>\[\]{}/%])|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<mark><<|>>|\[|\])|(?P<word>[^\s()<>\[\]{}/%]+)|(?P<string>\()|(?P<junk>.)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that opens before `at`, and the place behind it; an unclosed one ends with the data."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(m[0], 8) & 255)
                at = m.end()
                continue
            if m := re.compile(rb"\r\n|\r|\n").match(data, at + 1):
                at = m.end()
                continue
            e = data[at + 1 : at + 2]
            out += ESCAPES.get(e, e)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def plain(v):
    return {"hex": v.hex()} if isinstance(v, bytes) else v


def operations(data: bytes, deepest: int = 64) -> Iterator[tuple[str, list]]:
    """(operator, operands) of a content stream. Strings are {"hex"}, names "/Name"; what can't be read is passed over;
    an inline image is one operation INLINE with its dictionary and its bytes."""
    stack: list[list] = [[]]
    kinds: list[str] = []
    at = 0

    def close(kind: str) -> None:
        if kinds and kinds[-1] == kind:
            kinds.pop()
            got = stack.pop()
            stack[-1].append(got if kind == "[" else {str(k): v for k, v in zip(got[::2], got[1::2], strict=False)})

    while at < len(data):
        m = TOKEN.match(data, at)
        at = m.end()
        kind, raw = m.lastgroup, m[0]
        if kind == "number":
            stack[-1].append(float(raw) if b"." in raw else int(raw))
        elif kind == "name":
            stack[-1].append(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            stack[-1].append(plain(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
        elif kind == "string":
            got, at = literal(data, at)
            stack[-1].append(plain(got))
        elif kind == "mark":
            if raw in (b"[", b"<<"):
                if len(kinds) < deepest:
                    kinds.append(raw.decode())
                    stack.append([])
            else:
                close("[" if raw == b"]" else "<<")
        elif kind == "word":
            word = raw.decode("latin-1")
            if word in ("true", "false", "null"):
                stack[-1].append({"true": True, "false": False, "null": None}[word])
            elif word == "BI":
                stack, kinds = [[]], []
            elif word == "ID":
                end = re.compile(rb"\sEI(?=\s|$)").search(data, at)
                image = data[at + 1 : end.start() if end else len(data)]
                got = stack[0]
                yield "INLINE", [{str(k): v for k, v in zip(got[::2], got[1::2], strict=False)}, plain(image)]
                stack, kinds, at = [[]], [], end.end() if end else len(data)
            else:
                while kinds:
                    close(kinds[-1])
                yield word, stack[0]
                stack = [[]]


def operations_of(pages: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, seq, operator, operands as JSON) of the content (binary) of pages."""
    kinds = dict(pages.dtypes)

    def run(frames):
        for f in frames:
            rows = [(*k, i, op, json.dumps(args)) for *k, data in f[[*key, content]].itertuples(index=False) for i, (op, args) in enumerate(operations(bytes(data or b"")))]
            yield pd.DataFrame(rows, columns=[*key, "seq", "operator", "operands"])

    return pages.select(*key, content).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "seq long, operator string, operands string"]))


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def text_runs(ops: DataFrame, key: list[str]) -> DataFrame:
    """Text shown by a page's operations: the state of graphics and text folded in order. A row for each shown string
    (codes as hex) or gap of a TJ array (adjust), with font, size, spacing and the matrix at its begin."""
    kinds = dict(ops.dtypes)
    more = "run long, part long, codes string, adjust double, font string, font_size double, char_space double, word_space double, scale double, rise double, a double, b double, c double, d double, e double, f double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, fold = None, None
        for f in frames:
            out: list[tuple] = []
            for *k, op, raw in f[[*key, "operator", "operands"]].itertuples(index=False, name=None):
                if k != page:
                    page, fold = k, TextState()
                out += [(*k, *shown) for shown in fold.step(op, json.loads(raw))]
            yield pd.DataFrame(out, columns=[*key, *(c.split()[0] for c in more.split(", "))])

    # Pages come one after another in a partition, so that none is a group in memory.
    ordered = ops.select(*key, "seq", "operator", "operands").repartition(*key).sortWithinPartitions(*key, "seq")
    return ordered.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), more]))


class TextState:
    """The state of graphics and text of a page, and the number of strings shown so far."""

    def __init__(self) -> None:
        self.saved: list[dict] = []
        self.run = 0
        self.s = {"ctm": UNIT, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
        self.tm = self.tlm = UNIT

    def step(self, op: str, x: list) -> list[tuple]:
        """What an operation shows. One whose operands don't fit is passed over."""
        s, out = self.s, []
        try:
            if op == "q":
                self.saved.append(dict(s))
            elif op == "Q" and self.saved:
                self.s = s = self.saved.pop()
            elif op == "cm":
                s["ctm"] = times(tuple(map(float, x[:6])), s["ctm"])
            elif op == "BT":
                self.tm = self.tlm = UNIT
            elif op == "Tf":
                s["font"], s["size"] = x[0], float(x[1])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
                s[op] = float(x[0])
            elif op == "Tm":
                self.tm = self.tlm = tuple(map(float, x[:6]))
            elif op in ("Td", "TD", "T*", "'", '"'):
                if op == "TD":
                    s["TL"] = -float(x[1])
                if op == '"':
                    s["Tw"], s["Tc"] = float(x[0]), float(x[1])
                dx, dy = (float(x[0]), float(x[1])) if op in ("Td", "TD") else (0.0, -s["TL"])
                self.tm = self.tlm = times((1.0, 0.0, 0.0, 1.0, dx, dy), self.tlm)
            if op in ("Tj", "TJ", "'", '"'):
                for i, p in enumerate(x[0] if op == "TJ" else [x[-1]]):
                    codes = p["hex"] if isinstance(p, dict) else None
                    out.append((self.run, i, codes, 0.0 if codes is not None else float(p), s["font"], s["size"], s["Tc"], s["Tw"], s["Tz"] / 100, s["Ts"], *times(self.tm, s["ctm"])))
                self.run += 1
        except (IndexError, TypeError, ValueError, KeyError):
            pass
        return out


def glyphs(runs: DataFrame, widths: DataFrame, key: list[str], code_bytes: int = 1) -> DataFrame:
    """A row for each code of the shown runs, moved on by the advances before it in its run.

    widths: (font, code, unicode, width in thousandths, ascent, descent). Boxes go through the run's matrix.
    """
    n = 2 * code_bytes
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("codes") / n).cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substr("codes", i * n + 1, F.lit(n)), 16, 10).cast("int"))
    rows = runs.withColumn("_codes", F.when(F.length("codes") >= n, codes).otherwise(F.array(F.lit(None).cast("int")))).select("*", F.posexplode("_codes").alias("pos", "code")).drop("_codes")
    rows = rows.join(widths, ["font", "code"], "left")
    own = F.when(F.col("code").isNull(), -F.col("adjust") / 1000 * F.col("font_size")).otherwise(F.coalesce("width", F.lit(0.0)) / 1000 * F.col("font_size") + F.col("char_space") + F.when(F.col("code") == 32, F.col("word_space")).otherwise(0.0)) * F.col("scale")
    w = Window.partitionBy(*key, "run").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("_own").over(w), F.lit(0.0))
    g = rows.withColumn("_own", own).withColumn("_at", at).where("code is not null")
    m = F.struct(*[F.col(c) for c in "abcdef"])
    x0, x1 = F.col("_at"), F.col("_at") + F.coalesce("width", F.lit(0.0)) / 1000 * F.col("font_size") * F.col("scale")
    y0, y1 = (F.coalesce(c, F.lit(d)) / 1000 * F.col("font_size") + F.col("rise") for c, d in (("descent", -200.0), ("ascent", 800.0)))
    px = [x * m["a"] + y * m["c"] + m["e"] for x in (x0, x1) for y in (y0, y1)]
    py = [x * m["b"] + y * m["d"] + m["f"] for x in (x0, x1) for y in (y0, y1)]
    box = G.box(F.least(*px), F.least(*py), F.greatest(*px), F.greatest(*py))
    return g.select(*key, "run", "part", "pos", "code", "unicode", "font", "font_size", box.alias("box"), (F.abs(m["a"]) < F.abs(m["b"])).alias("vertical"))


def valid_chars(chars: DataFrame, mapped: DataFrame, unicode: str = "unicode") -> DataFrame:
    """Characters that are spaces, or are no control, private or glyph-number characters and whose font has the glyph."""
    good = (F.col(unicode) == " ") | (~F.col(unicode).rlike(r"^[\p{Cc}\p{Co}]|^\(cid:"))
    return chars.where(good).join(mapped.select("font", unicode), ["font", unicode], "left_semi")


def to_unicode(stream: Column) -> Column:
    """A ToUnicode stream as map<int, string>."""

    @F.arrow_udf("map<int, string>")
    def parse(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sorted(cmap(x).items()) for x in data.to_pylist()], pa.map_(pa.int32(), pa.string()))

    return parse(stream)


def cmap(data: bytes) -> dict[int, str]:
    """The text of each code; a range ends where Unicode does, as no code beyond could have a text."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    clean = lambda b: re.sub(rb"(?<=[0-9A-Fa-f])\s+(?=[0-9A-Fa-f]*>)", b"", b)
    for body in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", clean(body)):
            out[int(code, 16)] = text(to)
    for body in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for lo, hi, each, one in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:\[(.*?)\]|<([0-9A-Fa-f]+)>)", body, re.S):
            first, last = int(lo, 16), int(hi, 16)
            if one:
                base = text(one)
                for i in range(first, min(last, first + 0x10FFFF - ord(base[-1])) + 1 if base else first):
                    out[i] = base[:-1] + chr(ord(base[-1]) + i - first)
            else:
                for i, h in zip(range(first, last + 1), re.findall(rb"<([0-9A-Fa-f]+)>", each), strict=False):
                    out[i] = text(h)
    return out


def with_forms(ops: DataFrame, forms: DataFrame, key: list[str], deepest: int = 16) -> DataFrame:
    """Operations (key, seq, operator, operands) with those of named forms (key, name, seq, operator, operands) in place of
    their Do, forms within forms too. `path` (array<long>) is the order; `inside` the forms around, none of which is drawn
    again within itself. Past `deepest` levels a Do stays."""
    rows = ops.select(*key, F.array(F.col("seq").cast("long")).alias("path"), "operator", "operands", F.array().cast("array<string>").alias("inside"))
    own = forms.select(*key, F.col("name").alias("_name"), F.col("seq").cast("long").alias("_seq"), F.col("operator").alias("_op"), F.col("operands").alias("_args"))
    known = own.select(*key, F.col("_name").alias("_drawn")).distinct()
    for _ in range(deepest):
        name = F.when(F.col("operator") == "Do", F.from_json("operands", "array<string>")[0])
        calls = rows.withColumn("_drawn", F.when(~F.array_contains("inside", name), name))
        if not calls.join(known, [*key, "_drawn"], "left_semi").limit(1).count():
            break
        met = calls.withColumnRenamed("_drawn", "_name").join(own, [*key, "_name"], "left")
        got = F.col("_seq").isNotNull()
        rows = met.select(
            *key,
            F.when(got, F.concat("path", F.array("_seq"))).otherwise(F.col("path")).alias("path"),
            F.when(got, F.col("_op")).otherwise(F.col("operator")).alias("operator"),
            F.when(got, F.col("_args")).otherwise(F.col("operands")).alias("operands"),
            F.when(got, F.concat("inside", F.array("_name"))).otherwise(F.col("inside")).alias("inside"),
        )
    return rows
