"""Passes over documents that put several operators together: boundaries, units, names, placeholders, candidates, plans,
audits, and the seams where models are plugged in."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators.joins import small

BODY = ("text", "plain text", "paragraph_hybrid")


def sendable(paragraphs: DataFrame, taken: DataFrame | None = None, least: int = 5, body_only: bool = False) -> DataFrame:
    """Paragraphs to translate: with id and text, not vertical, not glyph numbers, long enough, not taken already."""
    p = paragraphs.where(F.col("debug_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= least) & ~F.coalesce(F.col("vertical"), F.lit(False)) & ~F.col("text").rlike(r"^(?:\(cid:\d+\)\s*)+$"))
    if body_only:
        p = p.where(F.col("layout_label").isin(*BODY))
    return p if taken is None else p.join(taken.select("debug_id"), "debug_id", "left_anti")


def solitary(units: DataFrame, page: list[str], idx: str, k: float = 1.0) -> DataFrame:
    """Units beside which nothing stands within k font sizes on their line."""
    a, b = units.alias("a"), units.select(*page, F.col(idx).alias("_j"), F.col("box").alias("_box")).alias("b")
    ab, bb = F.col("a.box"), F.col("b._box")
    gap = F.greatest(ab["x"] - bb["x2"], bb["x"] - ab["x2"])
    on = (F.col(f"a.{idx}") != F.col("b._j")) & (G.y_shared(ab, bb) > 0) & (gap <= k * F.col("a.font_size"))
    for c in page:
        on = (F.col(f"a.{c}") == F.col(f"b.{c}")) & on
    return a.join(b, on, "left_anti")


def page_column_pairs(units: DataFrame, doc: list[str]) -> DataFrame:
    """The last unit of each column beside the first of the next, and of the one after that (columns page, column, reading)."""
    key = [*doc, "page", "column"]
    ends = units.groupBy(*key).agg(F.min_by("par_idx", "reading").alias("first"), F.max_by("par_idx", "reading").alias("last"))
    w = Window.partitionBy(*doc).orderBy("page", "column")
    both = ends.select(*key, F.col("last").alias("tail"), *[F.lead(F.struct("page", "column", F.col("first").alias("head")), n).over(w).alias(f"next{n}") for n in (1, 2)])
    steps = [both.select(*key, "tail", F.lit(n).alias("skip"), F.col(f"next{n}.page").alias("head_page"), F.col(f"next{n}.column").alias("head_column"), F.col(f"next{n}.head").alias("head")) for n in (1, 2)]
    return steps[0].unionByName(steps[1]).where("head is not null")


def class_of_labels(labels: DataFrame, classes: DataFrame, key: str = "chain_id") -> DataFrame:
    """The one class (class, label) that holds all labels of a key; null where none or several do."""
    n = labels.select(key, "label").distinct().groupBy(key).agg(F.count("*").alias("_n"))
    held = labels.select(key, "label").distinct().join(small(classes.distinct()), "label").groupBy(key, "class").agg(F.count("*").alias("_held"))
    full = held.join(n, key).where("_held = _n").groupBy(key).agg(F.collect_set("class").alias("_c"))
    return n.join(full, key, "left").select(key, F.when(F.size("_c") == 1, F.col("_c")[0]).alias("class"))


def best_boundary(pairs: DataFrame, boundary: list[str], weights: dict[str, dict[str, float]], threshold: float) -> DataFrame:
    """The best of a boundary's class pairings (pair, eligible, reason and a column for each signal); the first declared
    wins ties; linked from the threshold on, else the reason."""
    order = F.array(*map(F.lit, weights))
    score = F.coalesce(*[F.when(F.col("pair") == p, G.combined({k: F.col(k) for k in w}, w)) for p, w in weights.items()])
    s = pairs.withColumn("score", F.when(F.col("eligible"), score))
    best = s.groupBy(*boundary).agg(F.min_by(F.struct("pair", "score", "reason"), F.struct(-F.coalesce("score", F.lit(-1.0)), F.array_position(order, F.col("pair")))).alias("_b")).select(*boundary, "_b.*")
    linked = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return best.withColumn("linked", linked).withColumn("reason", F.when(linked, None).otherwise(F.coalesce("reason", F.when(F.col("score").isNull(), "no_evidence").otherwise("below_threshold"))))


def adjudicated(boundaries: DataFrame, truth: DataFrame, markers: list[str]) -> DataFrame:
    """Each boundary as linked, trap (its note has a marker) or clean by the truth (boundary, linked, note); null without."""
    note = F.lower(F.coalesce("note", F.lit("")))
    trap = F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: note.contains(m)) if markers else F.lit(False)
    kind = F.when(F.col("_t").isNull(), None).when(F.col("truth_linked"), "linked").when(trap, "trap").otherwise("clean")
    t = truth.select("boundary", F.col("linked").alias("truth_linked"), "note", F.lit(True).alias("_t"))
    return boundaries.join(t, "boundary", "left").withColumn("adjudication", kind).drop("_t", "truth_linked", "note")


def harvested_names(paragraphs: DataFrame, stopwords: list[str], institutions: list[str], fewest: int = 2, most: int = 4, limit: int | None = None) -> DataFrame:
    """Capitalised runs that may be persons (words in bounds, no stop or institution words), with count and first page, by
    first page and name; with a limit the first so many of them."""
    n = paragraphs.select("page_number", F.explode(T.capitalised_terms(F.col("text"), 2)).alias("source"))
    words = F.split(F.lower("source"), r"\s+")
    n = n.where(F.size(words).between(fewest, most) & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in [*stopwords, *institutions, ""]])))
    found = n.groupBy("source").agg(F.count("*").alias("n"), F.min("page_number").alias("first_page")).orderBy("first_page", "source")
    return found if limit is None else found.limit(limit)


def first_pages(terms: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The first page whose text holds each term; null where none does."""
    from quire.operators.joins import terms_in_texts

    met = terms_in_texts(paragraphs.select("page_number", "text"), terms.select("source")).groupBy("source").agg(F.min("page_number").alias("first_page"))
    return terms.join(met, "source", "left")


def match_counts(terms: DataFrame, requests: DataFrame, excerpts: int = 3) -> DataFrame:
    """How many requests (id, text) each term reaches, and the first few of them."""
    from quire.operators.joins import terms_in_texts

    met = terms_in_texts(requests.select("id", "text"), terms.select("source"))
    few = met.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("id")))
    told = few.groupBy("source").agg(F.count("*").alias("matches"), F.array_sort(F.collect_list(F.when(F.col("_n") <= excerpts, F.struct("id", F.substring("text", 1, 80).alias("excerpt"))))).alias("samples"))
    return terms.join(told, "source", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def with_placeholders(runs: DataFrame, paragraph: list[str], order: str, most: int = 40) -> DataFrame:
    """What is sent of each paragraph's runs (text, kind: formula, styled or plain): formulas and styled runs get numbers;
    past `most` numbers styled runs are plain text; numbers and formulas alone get none."""
    w = Window.partitionBy(*paragraph)
    rich = runs.withColumn("_marks", F.count_if(F.col("kind") != "plain").over(w))
    mark = (F.col("kind") == "formula") | ((F.col("kind") == "styled") & (F.col("_marks") <= most))
    told = F.when(F.col("kind") == "plain", F.trim("text") != "").otherwise(F.col("kind") == "styled")
    r = rich.withColumn("_mark", mark).withColumn("_told", F.bool_or(told).over(w)).withColumn("_i", F.sum(F.col("_mark").cast("int")).over(w.orderBy(order)))
    piece = F.when(F.col("_told") & F.col("_mark") & (F.col("kind") == "formula"), F.concat(F.lit("{v"), F.col("_i"), F.lit("}"))).when(F.col("_told") & F.col("_mark"), F.concat(F.lit("<s"), F.col("_i"), F.lit(">"), "text", F.lit("</s"), F.col("_i"), F.lit(">"))).otherwise(F.col("text"))
    s = r.groupBy(*paragraph).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"), F.when(F.col("_mark"), F.col("_i")).alias("i")))).alias("_r"))
    return s.select(*paragraph, F.array_join(F.transform("_r", lambda x: x["p"]), "").alias("sent"), F.filter(F.transform("_r", lambda x: x["i"]), lambda i: i.isNotNull()).alias("marks"))


def parsed_reply(sent: Column, reply: Column) -> Column:
    """array<struct<kind, number, text>> of a reply: its placeholders (any case) and the text between; placeholders that
    weren't sent are left out."""

    @F.arrow_udf("array<struct<kind: string, number: int, text: string>>")
    def parse(a: pa.Array, b: pa.Array) -> pa.Array:
        mark = re.compile(r"\{v(\d+)\}|<s(\d+)>(.*?)</s\2>", re.I | re.S)
        out = []
        for src, got in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if got is None:
                out.append(None)
                continue
            known = {(m[1], m[2]) for m in mark.finditer(src or "")}
            parts, at = [], 0
            for m in mark.finditer(got):
                if got[at : m.start()]:
                    parts.append({"kind": "text", "number": None, "text": got[at : m.start()]})
                if (m[1], m[2]) in known:
                    parts.append({"kind": "formula", "number": int(m[1]), "text": None} if m[1] else {"kind": "styled", "number": int(m[2]), "text": m[3]})
                elif m[2]:
                    parts.append({"kind": "text", "number": None, "text": m[3]})
                at = m.end()
            if got[at:]:
                parts.append({"kind": "text", "number": None, "text": got[at:]})
            out.append(parts)
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("text", pa.string())])))

    return parse(sent, reply)


def drop_caps(paragraphs: DataFrame, runs: DataFrame, doc: list[str], labels: tuple[str, ...] = BODY, rank: int = 1, most: int = 2, ratio: float = 1.5) -> DataFrame:
    """Body paragraphs of an article, among its first or on an opening page, whose leading run is short and large
    (runs: doc, debug_id, initial, initial_size, median_size)."""
    w = Window.partitionBy(*doc, "article_id").orderBy("page_number", "par_idx")
    p = paragraphs.where(F.col("layout_label").isin(*labels) & F.col("article_id").isNotNull()).withColumn("rank", F.row_number().over(w))
    p = p.where((F.col("rank") <= rank) | F.coalesce(F.col("opens"), F.lit(False))).join(runs, [*doc, "debug_id"])
    return p.where((F.length("initial") <= most) & (F.col("initial_size") / F.nullif(F.col("median_size"), F.lit(0.0)) >= ratio)).select(*doc, "debug_id", "rank", "initial", (F.col("initial_size") / F.col("median_size")).alias("ratio"))


def contained_plans(issues: DataFrame, margin: float = 0.0, floor: float = 0.6) -> DataFrame:
    """A slide or a shrink for each box that leaves its bounds, refused by name below the scale floor."""
    bounds = G.inset(F.col("bounds"), margin)
    f = G.fit(F.col("box"), bounds)
    p = issues.withColumn("_f", f)
    why = F.when(F.col("box").isNull() | F.col("bounds").isNull(), "no_box").when(F.col("_f.scale") < floor, "scale_floor")
    act = F.when(why.isNotNull(), None).when(F.col("_f.scale") < 1, "shrink").when((F.col("_f.dx") != 0) | (F.col("_f.dy") != 0), "slide").otherwise("none")
    return p.select(*issues.columns, act.alias("action"), why.alias("refusal"), F.col("_f.scale").alias("scale"), F.col("_f.dx").alias("dx"), F.col("_f.dy").alias("dy"))


def separation_plans(pairs: DataFrame, coverage: float = 0.4, margin: float = 0.05, most_shift: float = 40.0, area_ratio: float = 0.8) -> DataFrame:
    """The cheapest slide (left, right, down, up) of the smaller box of each pair (box_a, box_b, page_box) that brings their
    coverage under the limit less a margin; refused by name: sizes too alike, too far, off the page."""
    smaller = G.area(F.col("box_a")) <= G.area(F.col("box_b"))
    mover, other = F.when(smaller, F.col("box_a")).otherwise(F.col("box_b")), F.when(smaller, F.col("box_b")).otherwise(F.col("box_a"))
    p = pairs.withColumns({"mover": mover, "other": other}).withColumn("_e", G.escape_distances(F.col("mover"), F.col("other"), coverage - margin))
    ways = F.array_sort(F.array(*[F.struct(F.col(f"_e.{n}").alias("cost"), F.lit(i).alias("rank"), (F.col(f"_e.{n}") * dx).alias("dx"), (F.col(f"_e.{n}") * dy).alias("dy")) for i, (n, dx, dy) in enumerate((("left", -1, 0), ("right", 1, 0), ("down", 0, -1), ("up", 0, 1)))]))
    p = p.withColumn("_w", ways[0])
    m, page = F.col("mover"), F.col("page_box")
    moved = G.box(m["x"] + F.col("_w.dx"), m["y"] + F.col("_w.dy"), m["x2"] + F.col("_w.dx"), m["y2"] + F.col("_w.dy"))
    o = G.overflow(moved, page)
    why = F.when(G.area(m) / F.nullif(G.area(F.col("other")), F.lit(0.0)) > area_ratio, "alike").when(F.col("_w.cost") > most_shift, "too_far").when(F.greatest(*[o[s] for s in G.SIDES]) > 0, "off_page")
    return p.select(*pairs.columns, F.when(smaller, "a").otherwise("b").alias("moves"), F.when(why.isNull(), F.col("_w.dx")).alias("dx"), F.when(why.isNull(), F.col("_w.dy")).alias("dy"), why.alias("refusal"))


def admitted(issues: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Issues with an action (issue kind -> actions) and the reason where it doesn't apply."""
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, a))) for k, a in kinds.items()], F.array().cast("array<string>"))
    why = F.when(~F.col("kind").isin(*kinds), "unknown_kind").when(~F.array_contains(allowed, F.col("action")), "action").when(F.size("paragraph_refs") != 1, "not_one_paragraph")
    return issues.withColumn("refusal", why)


def scanned(pages: DataFrame, doc: list[str], share: float = 0.8) -> DataFrame:
    """Documents of which at least that share of all pages (one at least) was found to be scanned; unseen pages count as text."""
    return pages.groupBy(*doc).agg((F.count_if(F.coalesce("is_scanned", F.lit(False))) >= F.greatest(share * F.count("*"), F.lit(1.0))).alias("scanned"))


def fragments_audited(paragraphs: DataFrame, words: DataFrame, page: list[str], most: int = 40) -> DataFrame:
    """How each short paragraph departs from the independently read words in its box: see text.band_fault."""
    short = paragraphs.where(F.length("text") <= most)
    b, c = F.col("box"), F.col("_w")
    met = short.join(words.select(*page, F.col("box").alias("_w"), F.col("text").alias("_t")), page, "left").withColumn("_in", (G.overlap_over_first(c, b) >= 0.5))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct((-c["y2"]).alias("y"), c["x"].alias("x"), F.col("_t").alias("t"))))), lambda r: r["t"]), " ")
    got = met.groupBy(*page, "debug_id").agg(F.first("text").alias("text"), seen.alias("words"))
    return got.withColumn("fault", T.band_fault(F.col("text"), F.col("words")))


def fields_set(rows: DataFrame, names: list[str]) -> DataFrame:
    """(field, rows) of the fields that should be unset and aren't."""
    n = rows.agg(*[F.count(c).alias(c) for c in names])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("rows")) for c in names])).alias("r")).select("r.*").where("rows > 0")


def render_units(**kinds: DataFrame) -> DataFrame:
    """Drawing units of chars, forms, rectangles and curves with a default order for each kind, in drawing order."""
    default = {"chars": 100, "forms": 50, "rectangles": 10, "curves": 20}
    out = None
    for k, df in kinds.items():
        own = df.withColumn("kind", F.lit(k)).withColumn("render_order", F.coalesce("render_order", F.lit(default[k])) if "render_order" in df.columns else F.lit(default[k]))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy("page_number", "render_order", "sub_order")


def streams_of(units: DataFrame, key: list[str]) -> DataFrame:
    """Operations of each target stream in drawing order, joined."""
    parts = F.array_sort(F.collect_list(F.struct("render_order", "sub_order", "op")))
    return units.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["op"]), "\n").alias("stream"))


def modelled(pages: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """The seam for layout models, scan detectors and judges: a model is made once a partition and given frames of pages."""

    def run(frames):
        predict = model()
        for f in frames:
            yield predict(f)

    return pages.mapInPandas(run, schema)


def detected(pages: DataFrame, page: list[str], session: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: list[str], least: float = 0.25, side: int = 1024) -> DataFrame:
    """(page, layout_id, class_name, conf, box) of page images (image: binary rows of grey pixels, width and height in
    pixels) by an object detector; box in the image's own pixels, y up.

    session() is made once a worker; it is given float images of side x side in 0..1, batch first, and gives for each an
    array of rows x, y, x2, y2, confidence, class in these pixels, y down. Images are scaled to fit and padded, and boxes
    are scaled back; rows under `least` confidence and of no listed class go.
    """
    kinds = dict(pages.dtypes)

    def run(frames):
        predict = session()
        for f in frames:
            images, scales = [], []
            for data, w, h in zip(f["image"], f["width"], f["height"], strict=True):
                grey, k = np.frombuffer(bytes(data), np.uint8).reshape(h, w), side / max(w, h)
                ys, xs = ((np.arange(max(1, int(n * k))) / k).astype(int).clip(0, n - 1) for n in (h, w))
                padded = np.zeros((side, side), np.float32)
                padded[: len(ys), : len(xs)] = grey[ys][:, xs] / 255
                images.append(padded)
                scales.append(k)
            out = []
            for *key, h, k, found in zip(*(f[c] for c in page), f["height"], scales, predict(np.stack(images)) if images else [], strict=True):
                n = 0
                for x, y, x2, y2, conf, kind in np.asarray(found, float).reshape(-1, 6):
                    if conf >= least and 0 <= int(kind) < len(classes):
                        out.append((*key, n, classes[int(kind)], float(conf), {"x": x / k, "y": h - y2 / k, "x2": x2 / k, "y2": h - y / k}))
                        n += 1
            yield pd.DataFrame(out, columns=[*page, "layout_id", "class_name", "conf", "box"])

    return pages.select(*page, "image", "width", "height").mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in page), f"layout_id int, class_name string, conf double, box {G.BOX}"]))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two grey images, over square windows of equal weight."""
    window = min(window, *a.shape)

    def mean(x: np.ndarray) -> np.ndarray:
        s = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    a, b = a.astype(float), b.astype(float)
    ma, mb, n = mean(a), mean(b), window**2 / max(1, window**2 - 1)
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def image_similarity(a: Column, b: Column, width: Column) -> Column:
    """SSIM of grey images (binary rows of `width` pixels); null where one is missing or their sizes differ."""

    @F.arrow_udf("double")
    def alike(one: pa.Array, two: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for x, y, w in zip(one.to_pylist(), two.to_pylist(), widths.to_pylist(), strict=True):
            fits = x and y and w and len(x) == len(y) and len(x) % w == 0
            out.append(ssim(np.frombuffer(x, np.uint8).reshape(-1, w), np.frombuffer(y, np.uint8).reshape(-1, w)) if fits else None)
        return pa.array(out, pa.float64())

    return alike(a, b, width)


def scan_pages(pages: DataFrame, least: float = 0.95) -> DataFrame:
    """pages (whole, textless: a page's images with and without its text, width) with is_scanned: the text makes no
    difference to be seen. Null where the images can't be compared."""
    return pages.withColumn("is_scanned", image_similarity(F.col("whole"), F.col("textless"), F.col("width")) > least)


def marked_scans(pages: DataFrame, doc: list[str], share: float = 0.8) -> DataFrame:
    """Documents of which more than that share of pages holds invisible text or artifact marks."""
    return pages.groupBy(*doc).agg((F.count_if(F.coalesce(F.col("invisible") | F.col("artifact"), F.lit(False))) > share * F.count("*")).alias("scanned"))


def hybrid_layout(first: DataFrame, second: DataFrame, page: list[str], least: float = 0.95) -> DataFrame:
    """Boxes of two layout services (ids from 1000 and 2000), most confident first; a text box that a hybrid paragraph all but
    equals takes the union of both."""
    both = first.withColumn("layout_id", F.col("layout_id") + 1000).withColumn("class_name", F.concat("class_name", F.lit("_hybrid"))).unionByName(second.withColumn("layout_id", F.col("layout_id") + 2000))
    h = both.where("class_name = 'paragraph_hybrid'").select(*page, F.col("box").alias("_h"))
    met = both.where("class_name = 'text'").join(h, page).where(G.iou(F.col("box"), F.col("_h")) > least).groupBy(*page, "layout_id").agg(F.min("_h.x").alias("_x"), F.min("_h.y").alias("_y"), F.max("_h.x2").alias("_x2"), F.max("_h.y2").alias("_y2"))
    b = F.col("box")
    grown = G.box(F.least(b["x"], "_x"), F.least(b["y"], "_y"), F.greatest(b["x2"], "_x2"), F.greatest(b["y2"], "_y2"))
    return both.join(met, [*page, "layout_id"], "left").withColumn("box", grown).drop("_x", "_y", "_x2", "_y2").orderBy(*page, F.desc("conf"), "layout_id")


def judged(rows: DataFrame, ask: Callable[[], Callable[[str], str]], prompt: str, schema: str, attempts: int = 2) -> DataFrame:
    """Rows' replies of a client, asked again up to `attempts` times while the reply is no JSON of the schema."""
    import json

    def run(frames):
        client = ask()
        for f in frames:
            out = []
            for p in f[prompt]:
                got = None
                for _ in range(attempts):
                    got = client(p)
                    try:
                        json.loads(got)
                        break
                    except (TypeError, ValueError):
                        got = None
                out.append(got)
            yield f.assign(_reply=out)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, _reply string").withColumn("reply", F.from_json("_reply", schema)).drop("_reply")


def cached_answers(requests: DataFrame, cache: DataFrame, ask: Callable[[], Callable[[str], str]], prompt: str, schema: str, save: Callable[[DataFrame], DataFrame], attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(requests with `digest` and `reply`, the new rows of the cache): replies from the cache (digest, reply: JSON) or of a
    client, which is asked once for each new prompt, again up to `attempts` times while its reply is no JSON.

    save(df) writes the new rows where all executors can read them, so that a client is not asked again. A reply that never
    becomes JSON, or holds nothing of the schema, is null and not kept.
    """
    from quire.functions.records import cache_digest

    keyed = requests.withColumn("digest", cache_digest(F.col(prompt)))
    known = cache.select("digest", "reply").dropDuplicates(["digest"])
    new = keyed.join(known, "digest", "left_anti").select("digest", F.col(prompt).alias("_prompt")).dropDuplicates(["digest"])
    fresh = save(judged(new, ask, "_prompt", schema, attempts).select("digest", F.to_json("reply").alias("reply")).where("reply is not null and reply != '{}'"))
    told = known.unionByName(fresh)
    return keyed.join(told, "digest", "left").withColumn("reply", F.from_json("reply", schema)), fresh
