"""From characters to text and paragraphs."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.folds import _numbered, folded
from quire.operators.joins import small

# Unicode categories whose characters begin a formula, and marks too flat to judge a line by.
FORMULA_CATEGORIES = ("Mn", "Sk", "Sm", "Zl", "Zp", "Zs", "Co")
FLAT = (".", ",", "'", "-", "_", "~", "—", "–", "·", "…")


def spaced(chars: DataFrame, paragraph: list[str], order: str) -> DataFrame:
    """chars with `space_before`: true where a space is wanted, at a gap of the paragraph's threshold or on a new line.

    The threshold is the second smallest distinct gap over 1, the only one if there is one, else 1.
    """
    w = Window.partitionBy(*paragraph).orderBy(order)
    before = F.lag("box").over(w)
    gap = F.round(F.col("box")["x"] - before["x2"], 6)
    line = F.coalesce(G.y_shared(F.col("box"), before) <= 0, F.lit(False))
    c = chars.withColumns({"_gap": gap, "_line": line})
    gaps = F.array_sort(F.collect_set(F.when((F.col("_gap") > 1) & ~F.col("_line"), F.col("_gap"))).over(Window.partitionBy(*paragraph)))
    limit = F.when(F.size(gaps) > 1, F.get(gaps, F.lit(1))).when(F.size(gaps) == 1, F.get(gaps, F.lit(0))).otherwise(1.0)
    blank = lambda u: F.trim(u) == ""
    want = (F.coalesce(F.col("_gap") >= limit, F.lit(False)) | F.col("_line")) & before.isNotNull() & ~blank(F.col("unicode")) & ~F.coalesce(blank(F.lag("unicode").over(w)), F.lit(True))
    return c.withColumn("_limit", limit).withColumn("space_before", want).drop("_gap", "_line", "_limit")


def texts(chars: DataFrame, paragraph: list[str], order: str) -> DataFrame:
    """Each paragraph's text: its characters in order under NFKC, spaces where spaced() wants them, white space collapsed."""
    piece = F.concat(F.when(F.col("space_before"), " ").otherwise(""), T.nfkc(F.col("unicode")))
    s = spaced(chars, paragraph, order).withColumn("_p", piece).groupBy(*paragraph).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_p").alias("p")))).alias("_r"))
    return s.select(*paragraph, F.trim(F.regexp_replace(F.array_join(F.transform("_r", lambda r: r["p"]), ""), r"\s+", " ")).alias("text"))


def with_space_rows(chars: DataFrame, paragraph: list[str], order: str) -> DataFrame:
    """chars with rows for the spaces that are wanted, each before its character (sub_order 0)."""
    s = spaced(chars, paragraph, order)
    space = F.struct(F.lit(" ").alias("unicode"), F.lit(0).alias("sub_order"))
    own = F.struct(F.col("unicode"), F.lit(1).alias("sub_order"))
    rest = [c for c in chars.columns if c != "unicode"]
    return s.select(*rest, F.explode(F.when(F.col("space_before"), F.array(space, own)).otherwise(F.array(own))).alias("_c")).select(*rest, "_c.*")


def paragraphs_of(chars: DataFrame, page: list[str], order: list[str], name: str = "par_idx") -> DataFrame:
    """Text characters (layout_id, xobj_id, unicode, area) grouped into paragraphs: a new one begins with another layout
    (a space doesn't begin one) or another form; specks within the layout and flat marks go with what stands before."""

    def number(g: pd.DataFrame) -> list[int]:
        speck = g["area"].median() * 0.05
        out, n, layout, form = [], -1, None, None
        for lay, x, u, a in zip(g["layout_id"], g["xobj_id"], g["unicode"], g["area"], strict=True):
            x = None if pd.isna(x) else x
            stays = n >= 0 and ((a < speck and lay == layout) or u in FLAT)
            if n < 0 or (not stays and ((lay != layout and u.strip()) or x != form)):
                n, layout = n + 1, lay
            form = x
            out.append(n)
        return out

    return _numbered(chars, page, order, name, number)


def begins_formula(char: Column, known: Column, pattern: str | None = None) -> Column:
    """A character that begins a formula: a glyph number, one that no font has, mathematical or modifying, Greek, a digit,
    a bracket or a bullet, or what the pattern matches."""

    @F.arrow_udf("boolean")
    def special(chars: pa.Array) -> pa.Array:
        return pa.array([None if c is None else bool(c) and c != " " and (unicodedata.category(c[0]) in FORMULA_CATEGORIES or "Ͱ" <= c[0] <= "Ͽ") for c in chars.to_pylist()], pa.bool_())

    more = char.rlike(f"^(?:{pattern})") if pattern else F.lit(False)
    return (F.length(char) > 0) & (char.contains("(cid:") | ~known | more | special(char) | char.rlike(r"^[0-9\[\]•]"))


def merged_formulas(formulas: DataFrame, paragraph: list[str], order: list[str]) -> DataFrame:
    """Formulas of one line joined until nothing changes: neighbours that one another's width holds and whose heights
    touch, neighbours side by side with half their height in common, formulas of one layout, and those of which one holds
    four fifths of the other (columns pos, line_id, layout_id, x, y, x2, y2)."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        items = [dict(r) for r in g.to_dict("records")]
        shared = lambda a, b, lo, hi: max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))

        def joins(a: dict, b: dict) -> bool:
            if a["line_id"] != b["line_id"]:
                return False
            both = shared(a, b, "x", "x2") * shared(a, b, "y", "y2")
            least = min((r["x2"] - r["x"]) * (r["y2"] - r["y"]) for r in (a, b))
            if (both and least > 0 and both / least > 0.8) or (pd.notna(a["layout_id"]) and a["layout_id"] == b["layout_id"]):
                return True
            if b["pos"] - a["last"] != 1:
                return False
            high = shared(a, b, "y", "y2")
            within = (a["x"] <= b["x"] and b["x2"] <= a["x2"]) or (b["x"] <= a["x"] and a["x2"] <= b["x2"])
            beside = abs(b["x"] - a["x2"]) <= 5 or abs(a["x"] - b["x2"]) <= 5
            return (within and high > 0) or (beside and high > 0.5 * min(a["y2"] - a["y"], b["y2"] - b["y"]))

        for r in items:
            r["last"], r["merged"] = r["pos"], [int(r["pos"])]
        moved = True
        while moved:
            moved = False
            for i in range(len(items)):
                for j in range(i + 1, len(items)):
                    a, b = items[i], items[j]
                    if joins(a, b):
                        a |= {"x": min(a["x"], b["x"]), "y": min(a["y"], b["y"]), "x2": max(a["x2"], b["x2"]), "y2": max(a["y2"], b["y2"]), "last": b["last"], "merged": a["merged"] + b["merged"], "layout_id": a["layout_id"] if a["layout_id"] == b["layout_id"] else None}
                        del items[j]
                        moved = True
                        break
                if moved:
                    break
        return pd.DataFrame(items)[[*paragraph, "pos", "line_id", "x", "y", "x2", "y2", "merged"]]

    kinds = dict(formulas.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*paragraph, "pos", "line_id", "x", "y", "x2", "y2"]) + ", merged array<long>"
    return folded(formulas, paragraph, order, merge, schema)


def language_profiles(rows: DataFrame, prefixes: DataFrame, default: str, language: str = "language") -> DataFrame:
    """rows with the `profile` of the longest prefix (prefix, profile) that their language tag is or begins with, at the end
    of a subtag; the default where there is none."""
    tag = F.translate(F.lower(F.trim(F.col(language))), "_.", "--")
    langs = rows.select(F.col(language).alias("_l"), tag.alias("_tag")).distinct()
    best = langs.join(small(prefixes), (F.col("_tag") == F.col("prefix")) | F.startswith(F.col("_tag"), F.concat("prefix", F.lit("-")))).groupBy("_l").agg(F.max_by("profile", F.length("prefix")).alias("_p"))
    return rows.join(best, F.col(language) == F.col("_l"), "left").withColumn("profile", F.coalesce("_p", F.lit(default))).drop("_l", "_p")


def flattened_initials(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs whose enlarged initial goes into the text: the made-up white space after it goes, the box begins where
    the body does (columns text, initial, box, body_box)."""
    begins = F.startswith(F.col("text"), F.col("initial"))
    rest = F.ltrim(F.expr("substring(text, length(initial) + 1)"))
    word = rest.rlike(r"^\p{Ll}")
    b, body = F.col("box"), F.col("body_box")
    closed = F.when(begins & word, F.concat("initial", rest)).otherwise(F.col("text"))
    return paragraphs.withColumns({"text": closed, "box": F.when(begins & word, G.box(F.least(b["x"], body["x"]), body["y"], F.greatest(b["x2"], body["x2"]), body["y2"])).otherwise(b)})


def single_line_scale(rows: DataFrame, least: float = 0.5, step: float = 0.05) -> DataFrame:
    """The largest scale (1 less whole steps) at which a heading of this width fits its room; null if none down to `least`."""
    steps = F.greatest(F.ceil(F.round((1 - F.col("room") / F.col("width")) / step, 9)), F.lit(0))
    scale = F.round(1 - steps * step, 6)
    return rows.withColumn("scale", F.when((F.col("width") > 0) & (scale >= least), scale).when(F.col("width") == 0, 1.0))


def rolled_back(before: DataFrame, after: DataFrame, issues_before: DataFrame, issues_after: DataFrame, page: list[str]) -> DataFrame:
    """after, but for pages where an issue of a kind became more frequent, which stay as they were before."""
    n = lambda df, name: df.groupBy(*page, "kind").agg(F.count("*").alias(name))
    worse = n(issues_after, "_a").join(n(issues_before, "_b"), [*page, "kind"], "left").where(F.col("_a") > F.coalesce("_b", F.lit(0))).select(*page).distinct()
    return after.join(worse, page, "left_anti").unionByName(before.join(worse, page, "left_semi"))


def repeats_at(runs: Column) -> Column:
    """The number of runs (array<string>) after which a heading says the same again; null where it doesn't."""
    said = lambda part: F.lower(F.regexp_replace(F.array_join(part, ""), r"\s+", ""))
    n = F.size(runs)
    cuts = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.filter(cuts, lambda k: (said(F.slice(runs, F.lit(1), k)) == said(F.slice(runs, k + 1, n))) & (said(F.slice(runs, F.lit(1), k)) != ""))
    return F.get(same, F.lit(0))


def clustered(chars: DataFrame, page: list[str], order: list[str], share: float = 0.5, reach: float = 1.5, name: str = "line") -> DataFrame:
    """Characters (x, y, x2, y2) in lines: each goes to the band with which it shares most of its height, `share` of it at
    least, which grows by it; a band falls apart where no centres are within `reach` mean heights of one another."""

    def number(g: pd.DataFrame) -> list[int]:
        bands: list[list] = []
        for i, (lo, hi) in enumerate(zip(g["y"], g["y2"], strict=True)):
            best = max(((min(hi, b) - max(lo, a)) / (hi - lo) if hi > lo else 0.0, -k) for k, (a, b, _) in enumerate(bands)) if bands else (0.0, 0)
            if bands and best[0] >= share:
                band = bands[-best[1]]
                band[0], band[1] = min(band[0], lo), max(band[1], hi)
                band[2].append(i)
            else:
                bands.append([lo, hi, [i]])
        cx, cy, n, out = (g["x"] + g["x2"]) / 2, (g["y"] + g["y2"]) / 2, 0, [0] * len(g)
        for _, _, own in bands:
            limit = reach * float((g["y2"] - g["y"]).iloc[own].mean())
            own = sorted(own, key=lambda i: (cx[i], i))
            group: dict[int, int] = {}
            for k, i in enumerate(own):
                near = {group[j] for j in own[:k] if abs(cx[i] - cx[j]) + abs(cy[i] - cy[j]) <= limit}
                if not near:
                    group[i] = n
                    n += 1
                    continue
                group[i] = min(near)
                for j in own[:k]:
                    if group[j] in near:
                        group[j] = min(near)
            for i in own:
                out[i] = group[i]
        first: dict[int, int] = {}
        return [first.setdefault(v, len(first)) for v in out]

    return _numbered(chars, page, order, name, number)


def joined_lines(lines: DataFrame, page: list[str], order: list[str], overlap: float = 0.5, gap: float = 2.0) -> DataFrame:
    """Lines (x, y, x2, y2) joined forward: one that lies within another, or side by side with `overlap` of both heights in
    common and a gap of `gap` heights at most; boxes grow. `members` has the places of what was joined."""

    def join(g: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for k, r in enumerate(g[[*page, "x", "y", "x2", "y2"]].to_dict("records")):
            for m in out:
                high = min(m["y2"], r["y2"]) - max(m["y"], r["y"])
                tall = max(m["y2"] - m["y"], r["y2"] - r["y"])
                within = m["x"] <= r["x"] and r["x2"] <= m["x2"] and m["y"] <= r["y"] and r["y2"] <= m["y2"]
                if within or (high >= overlap * tall > 0 and max(m["x"], r["x"]) - min(m["x2"], r["x2"]) <= gap * tall):
                    m |= {"x": min(m["x"], r["x"]), "y": min(m["y"], r["y"]), "x2": max(m["x2"], r["x2"]), "y2": max(m["y2"], r["y2"])}
                    m["members"].append(k)
                    break
            else:
                out.append(r | {"members": [k]})
        return pd.DataFrame(out)

    kinds = dict(lines.dtypes)
    return folded(lines, page, order, join, ", ".join([*(f"{c} {kinds[c]}" for c in page), "x double, y double, x2 double, y2 double, members array<long>"]))


def words_of(glyphs: DataFrame, page: list[str], order: list[str], gap: float = 0.3) -> DataFrame:
    """(page, word, text, box): words read from glyphs (unicode, font_size, box) alone, whatever paragraphs say: a word ends
    at a space, at a gap of `gap` font sizes and where a glyph shares less than half its height with the one before."""
    w = Window.partitionBy(*page).orderBy(*order)
    blank = F.trim("unicode") == ""
    b, before = F.col("box"), F.lag("box").over(w)
    new = blank | F.coalesce(F.lag(blank).over(w), F.lit(True)) | (b["x"] - before["x2"] > gap * F.col("font_size")) | (b["x"] < before["x"]) | (G.y_overlap_over_first(b, before) < 0.5)
    g = glyphs.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("word", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    letters = F.array_sort(F.collect_list(F.struct(*order, F.col("unicode").alias("_u"))))
    out = g.where(~blank).groupBy(*page, "word").agg(F.array_join(F.transform(letters, lambda x: x["_u"]), "").alias("text"), G.bounding_box(F.col("box")).alias("box"))
    return out.select(*page, "word", "text", "box")
