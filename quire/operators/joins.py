"""Joins of document tables. The key of a page (or of any scope) is a list of columns; boxes are quire.functions.geometry's."""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions.text import normal_term


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint, if it has no more rows than that; the count stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def banded(left: DataFrame, right: DataFrame, page: list[str], a: str, b: str, band: float | None) -> DataFrame:
    """left and right on one page; with `band` (a height in points) only pairs whose boxes a and b share a height, each once.

    Boxes are dealt to the bands of the page that they reach into, and meet in the first one that both reach, so that a page
    of very many boxes costs its neighbours and not all its pairs. A box without a height meets nothing.
    """
    if band is None:
        return left.join(right, page)
    low, high = (lambda c: F.floor(F.col(c)["y"] / band)), (lambda c: F.floor(F.col(c)["y2"] / band))
    one = left.withColumn("_band", F.explode(F.when(low(a) <= high(a), F.sequence(low(a), high(a)))))
    two = right.withColumn("_band", F.explode(F.when(low(b) <= high(b), F.sequence(low(b), high(b)))))
    return one.join(two, [*page, "_band"]).where(F.col("_band") == F.greatest(low(a), low(b))).drop("_band")


def layout_of(chars: DataFrame, layouts: DataFrame, page: list[str], char: list[str], priority: list[str], box: str = "box", band: float | None = None) -> DataFrame:
    """Each char with layout_id and class_name of the best layout that overlaps it, null where none does.

    Best: class in the order of `priority` (others last), then the larger share of the char, then the lesser layout_id.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("class_name")), F.lit(0)), F.lit(len(priority) + 1))
    right = layouts.select(*page, "layout_id", "class_name", F.col(box).alias("_box"), rank.alias("_rank"))
    met = banded(chars, right, page, box, "_box", band).where(G.intersection(F.col(box), F.col("_box")) > 0)
    best = met.groupBy(*page, *char).agg(F.min_by(F.struct("layout_id", "class_name"), F.struct("_rank", -G.overlap_over_first(F.col(box), F.col("_box")), "layout_id")).alias("_best"))
    return chars.join(best, [*page, *char], "left").withColumns({"layout_id": F.col("_best.layout_id"), "class_name": F.col("_best.class_name")}).drop("_best")


def one_layout(chars: DataFrame, formula: list[str], layout: str = "layout_id") -> DataFrame:
    """(formula, same): whether all of a formula's characters lie in one layout; those in none are a layout of their own."""
    return chars.groupBy(*formula).agg((F.count_distinct(F.coalesce(F.col(layout), F.lit(-1))) == 1).alias("same"))


def overlapping(items: DataFrame, others: DataFrame, page: list[str], ratio: float, box: str = "box", how: str = "left_semi", band: float | None = None) -> DataFrame:
    """Items that share more than `ratio` of their area with one of the others on their page (left_anti: that don't). With a
    band (see banded) items that are equal in page and box go one way together."""
    if band is not None:
        right = others.select(*page, F.col(box).alias("_box")).distinct()
        met = banded(items.select(*page, box).distinct(), right, page, box, "_box", band).where(G.overlap_over_first(F.col(box), F.col("_box")) > ratio)
        return items.join(met.select(*page, box).distinct(), [*page, box], how).select(*items.columns)
    a, b = items.alias("a"), others.select(*page, F.col(box).alias("_box")).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in page]
    on = G.overlap_over_first(F.col(f"a.{box}"), F.col("b._box")) > ratio
    for s in same:
        on = s & on
    return a.join(b, on, how)


def unprotected_lines(curves: DataFrame, paragraphs: DataFrame, figures: DataFrame, page: list[str], ratio: float, band: float | None = None) -> DataFrame:
    """Curves that paragraphs cover and no figure or table protects."""
    return overlapping(overlapping(curves, paragraphs, page, ratio, band=band), figures, page, ratio, how="left_anti", band=band)


def assigned_elements(elements: DataFrame, formulas: DataFrame, page: list[str], element: list[str], tolerance: float = 2.0) -> DataFrame:
    """(page, element, formula_idx, match_type, score): one formula for each element, exact matches (95 % inside) first,
    then elements within the formula but for a tolerance, nearest centre first."""
    a, b = F.col("box"), F.col("_box")
    inside = (a["x"] >= b["x"] - tolerance) & (a["x2"] <= b["x2"] + tolerance) & (a["y"] >= b["y"] - tolerance) & (a["y2"] <= b["y2"] + tolerance)
    share = G.overlap_over_first(a, b)
    away = F.hypot((a["x"] + a["x2"] - b["x"] - b["x2"]) / 2, (a["y"] + a["y2"] - b["y"] - b["y2"]) / 2)
    met = elements.join(formulas.select(*page, "formula_idx", F.col("box").alias("_box"), F.col("xobj_id").alias("_xobj")), page).where(F.col("_xobj").isNull() | F.col("xobj_id").eqNullSafe(F.col("_xobj")))
    met = met.withColumn("match_type", F.when(share >= 0.95, "exact").when(inside, "contained")).where("match_type is not null")
    met = met.withColumn("score", F.when(F.col("match_type") == "exact", share).otherwise(0.5 + 0.4 * F.greatest(F.lit(0.0), 1 - away / 100)))
    one = Window.partitionBy(*page, *element).orderBy(F.col("match_type") != "exact", F.desc("score"), "formula_idx")
    return met.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*page, *element, "formula_idx", "match_type", "score")


def collisions(paragraphs: DataFrame, page: list[str], idx: str, min_iou: float = 0.2, min_coverage: float = 0.4, source: DataFrame | None = None, source_iou: float = 0.05, band: float | None = None) -> DataFrame:
    """Pairs (a < b) on a page that stand on one another, but for those whose source boxes (page, idx, box) did already."""
    one = paragraphs.select(*page, F.col(idx).alias("a"), F.col("box").alias("box_a"))
    two = paragraphs.select(*page, F.col(idx).alias("b"), F.col("box").alias("box_b"))
    pairs = banded(one, two, page, "box_a", "box_b", band).where((F.col("a") < F.col("b")) & (G.intersection(F.col("box_a"), F.col("box_b")) > 0))
    pairs = pairs.withColumns({"iou": G.iou(F.col("box_a"), F.col("box_b")), "coverage": G.coverage(F.col("box_a"), F.col("box_b"))}).where((F.col("iou") >= min_iou) | (F.col("coverage") >= min_coverage))
    if source is not None:
        for side in "ab":
            pairs = pairs.join(source.select(*page, F.col(idx).alias(side), F.col("box").alias(f"src_{side}")), [*page, side], "left")
        pairs = pairs.where(~F.coalesce(G.iou(F.col("src_a"), F.col("src_b")) >= source_iou, F.lit(False)))
    return pairs.select(*page, "a", "b", "iou", "coverage")


def worst_overlap(paragraphs: DataFrame, artwork: DataFrame, page: list[str], idx: str, least: float, band: float | None = None) -> DataFrame:
    """Each paragraph's worst overlap (iou of `least` or more) with artwork (page, art, box)."""
    met = banded(paragraphs, artwork.select(*page, "art", F.col("box").alias("_box")), page, "box", "_box", band).withColumn("iou", G.iou(F.col("box"), F.col("_box"))).where(F.col("iou") >= least)
    return met.groupBy(*page, idx).agg(F.max("iou").alias("iou"), F.min_by("art", F.struct(-F.col("iou"), F.col("art"))).alias("art"))


def standing_on(candidates: DataFrame, others: DataFrame, page: list[str], idx: str, least: float) -> DataFrame:
    """For each candidate (page, idx, box): the others that its box overlaps by iou, in order; none: an empty list."""
    met = candidates.select(*page, idx, "box").join(others.select(*page, F.col(idx).alias("_other"), F.col("box").alias("_box")), page).where((F.col(idx) != F.col("_other")) & (G.iou(F.col("box"), F.col("_box")) >= least))
    found = met.groupBy(*page, idx).agg(F.sort_array(F.collect_set("_other")).alias("on"))
    return candidates.join(found, [*page, idx], "left").withColumn("on", F.coalesce("on", F.expr("array()")))


def induced(before: Column, after: Column) -> Column:
    """What is newly stood on."""
    return F.array_except(after, before)


def nearest_free(paragraphs: DataFrame, blockers: DataFrame, page: list[str], idx: str, crop: str = "crop") -> DataFrame:
    """right_limit and bottom_limit of each paragraph: the nearest blocker beside and below it, or the page's margin."""
    a, b = F.col("box"), F.col("_box")
    met = paragraphs.join(blockers.select(*page, F.col("idx").alias("_other"), F.col("box").alias("_box")), page, "left")
    beside = (b["x"] >= a["x2"]) & (G.y_shared(a, b) > 0)
    below = (b["y2"] <= a["y"]) & (G.x_shared(a, b) > 0)
    return met.groupBy(*page, idx).agg(
        F.least(F.first(F.col(crop)["x2"] * 0.9), F.min(F.when(beside, b["x"]))).alias("right_limit"),
        F.greatest(F.first(F.col(crop)["y"] * 1.1), F.max(F.when(below, b["y2"]))).alias("bottom_limit"),
    )


def nearest_sides(formulas: DataFrame, chars: DataFrame, line: list[str], idx: str) -> DataFrame:
    """The nearest char to the left and to the right of each formula on its line, and the gaps."""
    a, b = F.col("box"), F.col("_box")
    met = formulas.join(chars.select(*line, "char_idx", F.col("box").alias("_box")), line, "left")
    left, right = b["x2"] <= a["x"], b["x"] >= a["x2"]
    return met.groupBy(*line, idx).agg(
        F.max_by(F.when(left, F.col("char_idx")), F.when(left, F.struct(b["x2"], -F.col("char_idx")))).alias("left_char"), F.min(F.when(left, a["x"] - b["x2"])).alias("left_gap"),
        F.min_by(F.when(right, F.col("char_idx")), F.when(right, F.struct(b["x"], F.col("char_idx")))).alias("right_char"), F.min(F.when(right, b["x"] - a["x2"])).alias("right_gap"),
    )


def first_font(chars: DataFrame, fonts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Each char with the first font (by priority) that has its glyph and its style flags; null where none has."""
    can = glyphs.join(fonts, "font_id").select("font_id", "unicode", "bold", "italic", "priority")
    best = can.groupBy("unicode", "bold", "italic").agg(F.min_by("font_id", "priority").alias("mapped_font"))
    return chars.join(best, ["unicode", "bold", "italic"], "left")


def scoped(rows: DataFrame, fonts: DataFrame, key: str = "font_id") -> DataFrame:
    """rows (scope, key) with the `font` of their scope, or else of the page (scope 0)."""
    own = fonts.select("scope", key, F.col("font").alias("_own"))
    page = fonts.where("scope = 0").select(key, F.col("font").alias("_page"))
    return rows.join(own, ["scope", key], "left").join(page, key, "left").withColumn("font", F.coalesce("_own", "_page")).drop("_own", "_page")


def terms_in_texts(texts: DataFrame, glossary: DataFrame, text: str = "text", source: str = "source", most: int = 200_000) -> DataFrame:
    """Pairs of texts and glossary entries whose source stands in them: ASCII case and runs of white space don't count.

    One automaton holds all terms, so a text is read once; it is built once a worker. A glossary of more than `most` entries
    is taken in parts.
    """
    term = F.trim(F.regexp_replace(ascii_lower(F.col(source)), r"\s+", " "))
    entries = glossary.select("*", term.alias("_term")).where("_term != ''").dropDuplicates(["_term"])
    size = entries.count()
    parts = max(1, -(-size // most))
    out = None
    for k in range(parts):
        own = entries.where(F.pmod(F.xxhash64("_term"), F.lit(parts)) == k) if parts > 1 else entries
        terms = texts.sparkSession.sparkContext.broadcast(sorted(r[0] for r in own.select("_term").collect()))
        # All white space as one space in generated code; the automaton sees the text as it is then.
        flat = F.regexp_replace(ascii_lower(F.col(text)), r"\s+", " ")
        part = texts.withColumn("_term", F.explode(found_in(flat, terms))).join(small(own), "_term").drop("_term")
        out = part if out is None else out.unionByName(part)
    return out


_automata: dict[str, ahocorasick.Automaton] = {}


def found_in(text: Column, terms: Broadcast) -> Column:
    """The terms (a broadcast list) that stand in a text, each once, in order."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        auto = automaton(name, terms)
        return pa.array([sorted({t for _, t in auto.iter(x)}) if x and len(auto) else [] for x in texts.to_pylist()], pa.list_(pa.string()))

    return found(text)


def automaton(name: str, terms: Broadcast) -> ahocorasick.Automaton:
    """One for each worker process and list of terms; the last few are kept."""
    if name not in _automata:
        auto = ahocorasick.Automaton()
        for t in terms.value:
            auto.add_word(t, t)
        auto.make_automaton()
        while len(_automata) > 3:
            del _automata[next(iter(_automata))]
        _automata[name] = auto
    return _automata[name]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unlisted_terms(rows: DataFrame, glossary: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose term no glossary entry has, in normal form."""
    return rows.join(small(glossary.select(normal_term(F.col(source)).alias("_k")).distinct()), normal_term(rows[source]) == F.col("_k"), "left_anti")


def overlaid(defaults: DataFrame, rulings: DataFrame, key: list[str], value: str) -> DataFrame:
    """defaults with ruled values where there are any; `was` keeps the default."""
    return defaults.withColumnRenamed(value, "was").join(rulings.select(*key, F.col(value).alias("_ruled")), key, "left").withColumn(value, F.coalesce("_ruled", "was")).drop("_ruled")


def merged_terms(extracted: DataFrame, harvested: DataFrame) -> DataFrame:
    """Terms (source, target, first_page) of both; an extracted row wins and notes that it was harvested too."""
    k = normal_term(F.col("source")).alias("k")
    e = extracted.select(k, "source", "target", "first_page")
    h = harvested.select(k, F.col("source").alias("h_source"), F.col("target").alias("h_target"), F.col("first_page").alias("h_page"))
    origin = F.when(F.col("source").isNull(), "harvest").when(F.col("h_source").isNull(), "extractor").otherwise("both")
    return e.join(h, "k", "full").select("k", F.coalesce("source", "h_source").alias("source"), F.coalesce("target", "h_target").alias("target"), F.least("first_page", "h_page").alias("first_page"), origin.alias("origin"))


def adjacent(rows: DataFrame, scope: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row beside the one that comes next in its scope (columns next_<name>); the last has none and goes."""
    w = Window.partitionBy(*scope).orderBy(order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in [order, *columns]}).where(F.col(f"next_{order}").isNotNull())


def same_article(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """pairs (first, second) whose pages (page, article_id) lie in one article."""
    one, two = pages.select(F.col("page").alias("first"), F.col("article_id").alias("_a")), pages.select(F.col("page").alias("second"), F.col("article_id").alias("_b"))
    return pairs.join(one, "first").join(two, "second").where("_a = _b").withColumnRenamed("_a", "article_id").drop("_b")


def scored_labels(verdicts: DataFrame, labels: DataFrame, policies: DataFrame) -> DataFrame:
    """verdicts (file, page, kind) against labels (file, page, accepted): hit, and hit by policy alone."""
    accepted = labels.select("file", "page", F.explode("accepted").alias("kind")).join(small(policies), "kind").groupBy("file", "page").agg(F.collect_set("policy").alias("_policies"))
    j = verdicts.join(labels, ["file", "page"]).join(small(policies), "kind", "left").join(accepted, ["file", "page"], "left")
    policy_hit = F.coalesce(F.array_contains("_policies", F.col("policy")), F.lit(False))
    return j.withColumns({"hit": F.array_contains("accepted", F.col("kind")), "policy_hit": policy_hit}).drop("_policies", "policy")
