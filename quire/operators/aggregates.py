"""Aggregations: votes, features, rules, metrics and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.joins import banded


def ratio(numerator: Column, denominator: Column) -> Column:
    """Sums by sums; null where there is nothing to divide by."""
    return F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0))


def voted(rows: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """Each key's most frequent value; of equals the one seen first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("votes"), F.min(seq).alias("first_seq"))
    return counts.groupBy(*key).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col("first_seq"))).alias("_v")).select(*key, f"_v.{value}", "_v.votes")


def without_descent(chars: DataFrame, page: list[str], font: str = "font_id", descent: str = "descent", box: str = "box", seq: str = "char_idx") -> DataFrame:
    """chars with their boxes raised by the descent that most characters of their font on the page have."""
    common = voted(chars, [*page, font], descent, seq).select(*page, font, F.col(descent).alias("_d"))
    b = F.col(box)
    return chars.join(common, [*page, font], "left").withColumn(box, G.box(b["x"], b["y"] - F.coalesce("_d", F.lit(0.0)), b["x2"], b["y2"] - F.coalesce("_d", F.lit(0.0)))).drop("_d")


def weighted_mode(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """Each key's value of greatest total weight; of equals the smallest."""
    sums = rows.groupBy(*key, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("weight"), F.col(value))).alias(value))


def clamped_to_mode(rows: DataFrame, key: list[str], value: str, weight: str) -> DataFrame:
    """rows with `value` no greater than their key's weighted mode."""
    mode = weighted_mode(rows, key, value, weight).withColumnRenamed(value, "_mode")
    return rows.join(mode, key).withColumn(value, F.least(F.col(value), F.col("_mode"))).drop("_mode")


def agreed(value: str, tolerance: float | None = None) -> Column:
    """Aggregate: the value that all rows agree on (numbers within a tolerance), else null."""
    same = F.max(value) - F.min(value) <= tolerance if tolerance is not None else F.count_distinct(value) == 1
    return F.when(same & (F.count(value) == F.count(F.lit(1))), F.first(value, ignorenulls=True))


def grid_coverage(boxes: DataFrame, page: list[str], n: int = 64, unit: str = "unit") -> DataFrame:
    """Share of the n x n cells of the unit page that boxes touch."""
    b = F.col(unit)
    cell = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int")
    last = lambda v: F.least(F.greatest(F.ceil(v * n) - 1, F.lit(0)), F.lit(n - 1)).cast("int")
    some = boxes.where((G.area(b) > 0) & (b["x"] < 1) & (b["y"] < 1) & (b["x2"] > 0) & (b["y2"] > 0))
    # One bitmap of columns for each row of cells: rows of a page meet as 64 numbers, not as cells.
    if n <= 63:
        bits = F.aggregate(F.sequence(cell(b["x"]), F.greatest(cell(b["x"]), last(b["x2"]))), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        rows = some.select(*page, F.explode(F.sequence(cell(b["y"]), F.greatest(cell(b["y"]), last(b["y2"])))).alias("_r"), bits.alias("_m"))
        return rows.groupBy(*page, "_r").agg(F.bit_or("_m").alias("_m")).groupBy(*page).agg((F.sum(F.bit_count("_m")) / float(n * n)).alias("coverage"))
    rows = some.select(*page, F.explode(F.sequence(cell(b["y"]), F.greatest(cell(b["y"]), last(b["y2"])))).alias("_r"), F.sequence(cell(b["x"]), F.greatest(cell(b["x"]), last(b["x2"]))).alias("_cs"))
    return rows.select(*page, "_r", F.explode("_cs").alias("_c")).distinct().groupBy(*page).agg((F.count("*") / float(n * n)).alias("coverage"))


def column_count(rows: DataFrame, page: list[str], centre: str, gap: float = 0.05, most: int = 4) -> DataFrame:
    """Groups of x centres with a gap between them, `most` at most."""
    w = Window.partitionBy(*page).orderBy(centre)
    cut = (F.col(centre) - F.lag(centre).over(w) >= gap).cast("int")
    return rows.withColumn("_cut", cut).groupBy(*page).agg(F.least(F.coalesce(F.sum("_cut"), F.lit(0)) + 1, F.lit(most)).alias("columns"))


def scored_types(features: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """(key, page_type, score): weight of the rules that hold by the weight above zero of those that can be judged.

    features: long (key, feature, value); a rule whose feature is null is not judged, a penalty counts in the sum alone,
    a type with no positive rule that holds scores 0, and scores stay in 0..1.
    """
    v, t, w = F.col("value"), F.col("threshold"), F.col("weight")
    holds = F.when(F.col("op") == "ge", v >= t).when(F.col("op") == "le", v <= t).when(F.col("op") == "gt", v > t).when(F.col("op") == "lt", v < t)
    j = features.join(F.broadcast(rules) if rules.limit(10_001).count() <= 10_000 else rules, "feature").withColumn("_holds", holds)
    got, could = F.sum(F.when(F.col("_holds"), w).otherwise(0.0)), F.sum(F.when(v.isNotNull() & (w > 0), w).otherwise(0.0))
    evidence = F.coalesce(F.bool_or(F.col("_holds") & (w > 0)), F.lit(False))
    score = F.when(evidence & (could > 0), F.least(F.greatest(got / could, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return j.groupBy(*key, "page_type").agg(score.alias("score"))


def classified(scores: DataFrame, key: list[str], order: list[str], default: str, margin: float = 0.15) -> DataFrame:
    """The type of highest score (the first declared of equals), `default` where all are 0, and whether it was close."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("page_type"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), rank.alias("r"), "page_type")))
    s = scores.groupBy(*key).agg(best.alias("_b"))
    top, second = -F.col("_b")[0]["s"], -F.try_element_at("_b", F.lit(2))["s"]
    return s.select(*key, F.when(top > 0, F.col("_b")[0]["page_type"]).otherwise(default).alias("page_kind"), top.alias("score"), F.coalesce((top > 0) & (top - second < margin), F.lit(False)).alias("ambiguous"))


def upper_median(value: str) -> Column:
    """Aggregate: the element at n / 2 of the sorted values."""
    v = F.sort_array(F.collect_list(value))
    return v[F.floor(F.size(v) / 2).cast("int")]


def line_spacing(lines: DataFrame, paragraph: list[str], order: str, top: str, default: float = 10.0) -> DataFrame:
    w = Window.partitionBy(*paragraph).orderBy(order)
    gaps = lines.withColumn("_gap", F.abs(F.col(top) - F.lag(top).over(w)))
    return gaps.groupBy(*paragraph).agg(F.coalesce(upper_median_of(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(default)).alias("spacing"))


def upper_median_of(value: Column) -> Column:
    v = F.sort_array(F.collect_list(value))
    return F.when(F.size(v) > 0, F.get(v, F.floor(F.size(v) / 2).cast("int")))


def qualifying_terms(uses: DataFrame, region: list[str], least: int = 3, paragraphs: int = 1, most: int = 40) -> DataFrame:
    """Terms (region, term, paragraph, mid_sentence) used often enough, somewhere within a sentence; the top of a region."""
    t = uses.groupBy(*region, "term").agg(F.count("*").alias("n"), F.bool_or("mid_sentence").alias("mid"), F.count_distinct("paragraph").alias("paragraphs"))
    t = t.where((F.col("n") >= least) & F.col("mid") & (F.col("paragraphs") >= paragraphs))
    w = Window.partitionBy(*region).orderBy(F.desc("n"), "term")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("mid")


def pair_consistency(groups: DataFrame, key: list[str], size: str, total: str) -> DataFrame:
    """Pairs within groups of one rendering, by all pairs: numerator, denominator and ratio of each key."""
    pairs = lambda n: n * (n - 1) / 2
    g = groups.groupBy(*key).agg(F.sum(pairs(F.col(size))).alias("numerator"), F.first(pairs(F.col(total))).alias("denominator"))
    return g.withColumn("ratio", F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)))


def corpus_ratio(rows: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Numerators and denominators summed, never ratios averaged."""
    out = rows.groupBy(*(by or [])).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return out.withColumn("ratio", F.bround(F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)), digits))


def strata(rows: DataFrame, stratum: str, value: str) -> DataFrame:
    """Count, open count and rate of each stratum and of all (stratum null, level 1)."""
    return rows.rollup(stratum).agg(F.count("*").alias("n"), F.count_if(F.col(value)).alias("open"), F.grouping(stratum).cast("int").alias("level")).withColumn("rate", F.col("open") / F.col("n"))


def strict_rate(open_: Column, answerable: Column, designed: Column) -> Column:
    """Open by (answerable less designed); null if nothing is left."""
    left = F.count_if(answerable) - F.count_if(designed)
    return F.when(left > 0, F.count_if(open_) / left)


def leave_one_out(rows: DataFrame, group: str, hit: str) -> DataFrame:
    """Totals of all groups but one, for each: the total less the group's own."""
    own = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits"))
    w = Window.partitionBy()  # a row for each group only
    return own.select(group, (F.sum("n").over(w) - F.col("n")).alias("n"), (F.sum("hits").over(w) - F.col("hits")).alias("hits")).withColumn("rate", F.col("hits") / F.nullif(F.col("n"), F.lit(0)))


def element_overlap(elements: DataFrame, page: list[str], idx: str = "idx", unit: str = "unit", band: float | None = None) -> DataFrame:
    """Mean over a page's elements of the share of each that the others cover. Shares are summed as decimals, so that the
    result doesn't depend on the order of rows. band: see quire.operators.joins.banded."""
    a, b = elements.select(*page, F.col(idx).alias("_i"), F.col(unit).alias("_a")), elements.select(*page, F.col(idx).alias("_j"), F.col(unit).alias("_b"))
    share = G.overlap_over_first(F.col("_a"), F.col("_b")).cast("decimal(38,12)")
    own = banded(a, b, page, "_a", "_b", band).where("_i != _j").groupBy(*page, "_i").agg(F.sum(share).alias("_o"))
    mean = F.sum(F.coalesce("_o", F.lit(0).cast("decimal(38,12)"))).cast("double") / F.count("*")
    return a.join(own, [*page, "_i"], "left").groupBy(*page).agg(mean.alias("overlap"))


def element_alignment(elements: DataFrame, page: list[str], idx: str = "idx", unit: str = "unit") -> DataFrame:
    """Mean over elements of -log(1 - d), d the least difference to another element's same coordinate of six."""
    c = elements.select(*page, F.col(idx).alias("_i"), F.posexplode(G.alignment_coordinates(F.col(unit))).alias("_k", "_v"))
    w = Window.partitionBy(*page, "_k").orderBy("_v", "_i")
    near = F.least(F.col("_v") - F.lag("_v").over(w), F.lead("_v").over(w) - F.col("_v"))
    return c.withColumn("_d", near).groupBy(*page, "_i").agg(F.min("_d").alias("_d")).groupBy(*page).agg(F.avg(G.clipped_log(F.col("_d"))).alias("alignment"))


def relative_delta(a: Column, b: Column) -> Column:
    """|a - b| by the larger, 0 where both are 0, null where one is missing."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(most == 0, 0.0).otherwise(F.abs(a - b) / most)


def tiling(segments: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Whether a chain's spans lie end to end and their texts join to the translation again; null without segments' texts."""
    w = Window.partitionBy(chain).orderBy("chain_index")
    s = segments.withColumn("_gap", F.coalesce(F.lag("end").over(w), F.lit(0)) != F.col("start"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain_index", "text"))), lambda x: x["text"]), "")
    return s.groupBy(chain).agg((~F.bool_or("_gap")).alias("tiles"), (text == F.first("translation")).alias("rejoins"), F.count("*").alias("members"))


def all_levels(*levels: Column) -> Column:
    """True or false over the levels that are there, null if none is."""
    there = F.filter(F.array(*levels), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.forall(there, lambda x: x))


def changed(before: DataFrame, after: DataFrame, key: list[str], digest: str = "digest") -> DataFrame:
    """Keys that were added, removed or altered between two tables of digests."""
    j = before.select(*key, F.col(digest).alias("_b")).join(after.select(*key, F.col(digest).alias("_a")), key, "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "altered")
    return j.withColumn("change", kind).where("change is not null").select(*key, "change")


def evictable(files: DataFrame, limit: int, volume: str) -> DataFrame:
    """Least recently used files of each volume that go until what stays is within the limit."""
    w = Window.partitionBy(volume).orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(volume)
    return files.withColumn("_left", F.sum("size").over(total) - F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("_left") > limit).drop("_left")


def stage_totals(runs: DataFrame) -> DataFrame:
    """Seconds and runs of each stage, longest first, and its share of the attributed time."""
    t = runs.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs"))
    return t.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy())).orderBy(F.desc("seconds"), "stage")  # a row a stage
