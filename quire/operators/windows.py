"""Operators over ordered rows that a window can say: islands, neighbours, ranks and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T


def islands(rows: DataFrame, scope: list[str], order: list[str], cut: Column, name: str = "island") -> DataFrame:
    """rows with the number of their island: `cut` (which may look back by lag() over the same order) begins a new one."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn(name, F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def previous(column: str | Column, scope: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*scope).orderBy(*order))


def following(column: str | Column, scope: list[str], order: list[str], n: int = 1) -> Column:
    return F.lead(column, n).over(Window.partitionBy(*scope).orderBy(*order))


def runs(rows: DataFrame, scope: list[str], order: list[str], *columns: str) -> DataFrame:
    """Islands of equal values (nulls are equal): style runs, formula runs, roles of turns."""
    cut = F.lit(False)
    for c in columns:
        cut = cut | ~previous(c, scope, order).eqNullSafe(F.col(c))
    return islands(rows, scope, order, cut)


def lines_of(chars: DataFrame, scope: list[str], order: list[str], least: float = 0.5) -> DataFrame:
    """Characters to lines: one starts where a character overlaps the one before by less than `least` of its height."""
    before = previous("box", scope, order)
    return islands(chars, scope, order, G.y_overlap_over_first(F.col("box"), before) < least, "line")


def split_paragraphs(lines: DataFrame, scope: list[str], order: list[str], median_width: str, factor: float = 0.8, dots: int = 20) -> DataFrame:
    """A paragraph ends after a dot leader and after a short line, and a list item begins one."""
    before_text, before_width = previous("text", scope, order), previous(G.width(F.col("box")), scope, order)
    cut = before_text.rlike(r"\.{" + str(dots) + ",}") | (before_width < F.col(median_width) * factor) | T.bullet(F.substring(F.ltrim("text"), 1, 1))
    return islands(lines, scope, order, cut, "part")


def line_numbers_merged(paragraphs: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Paragraphs that only line numbers part, in one layout and form, share an island; the numbers go to it too."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = T.digits_or_space(F.col("text"))
    same = lambda c: F.last(F.when(~number, F.col(c)), ignorenulls=True).over(w).eqNullSafe(F.col(c))
    after_number = previous(number, scope, order)
    cut = ~number & ~(F.coalesce(after_number, F.lit(False)) & same("layout_id") & same("xobj_id"))
    return islands(paragraphs, scope, order, cut, "merged")


def fragment_runs(paragraphs: DataFrame, scope: list[str], order: list[str], most_chars: int = 40, least: int = 3, gap: float = 1.5, overlap: float = 0.5, tolerance: float = 0.05) -> DataFrame:
    """Runs of at least `least` short neighbours of like size, over one another, with small gaps."""
    b, p = F.col("box"), previous("box", scope, order)
    size, before = F.col("font_size"), previous("font_size", scope, order)
    short = F.length("text") <= most_chars
    near = (G.x_overlap_over_narrower(b, p) >= overlap) & (F.greatest(p["y"] - b["y2"], F.lit(0.0)) <= gap * size) & (F.abs(size - before) <= tolerance * F.greatest(size, before))
    cut = ~(F.coalesce(near, F.lit(False)) & short & F.coalesce(previous(short, scope, order), F.lit(False)))
    r = islands(paragraphs, scope, order, cut, "run")
    return r.withColumn("_n", F.count("*").over(Window.partitionBy(*scope, "run"))).where((F.col("_n") >= least) & short).drop("_n")


def record_groups(lines: DataFrame, scope: list[str], order: list[str], gap: str = "gap", ratio: float = 1.5) -> DataFrame:
    """A record begins where the gap before a line is `ratio` times its paragraph's median gap."""
    middle = F.percentile(gap, 0.5).over(Window.partitionBy(*scope))
    return islands(lines.withColumn("_m", middle), scope, order, F.col(gap) >= ratio * F.col("_m"), "record").drop("_m")


def midranks(rows: DataFrame, scope: list[str], value: str, name: str | None = None) -> DataFrame:
    """(below + half of the equal) / all, of the values that are not null."""
    w = Window.partitionBy(*scope, F.col(value).isNull())
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*scope, value))
    return rows.withColumn(name or f"{value}_rank", F.when(F.col(value).isNotNull(), (below + 0.5 * equal) / F.count("*").over(w)))


def endpoints(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """rows that are first or last of their scope: is_first, is_last."""
    up, down = Window.partitionBy(*scope).orderBy(*order), Window.partitionBy(*scope).orderBy(*[F.desc(c) for c in order])
    r = rows.withColumns({"is_first": F.row_number().over(up) == 1, "is_last": F.row_number().over(down) == 1})
    return r.where("is_first or is_last")


def reading_ranks(units: DataFrame, page: list[str], column: str = "column", box: str = "box") -> DataFrame:
    """Order by column, from the top down, from the left."""
    b = F.col(box)
    return units.withColumn("reading", F.row_number().over(Window.partitionBy(*page).orderBy(column, b["y2"].desc(), b["x"])))


def travel(units: DataFrame, scope: list[str], order: list[str], box: str = "box") -> DataFrame:
    """Signed and absolute ways from unit to unit, and whether the stored order runs up and down rather than across."""
    b, n = F.col(box), following(box, scope, order)
    r = units.withColumns({"_dx": n["x"] - b["x"], "_dy": n["y"] - b["y"]}).groupBy(*scope).agg(F.sum("_dx").alias("dx"), F.sum("_dy").alias("dy"), F.sum(F.abs("_dx")).alias("across"), F.sum(F.abs("_dy")).alias("down"))
    return r.withColumn("vertical", F.coalesce(F.col("down") > F.col("across"), F.lit(False)))


def chained(boundaries: DataFrame, doc: list[str]) -> DataFrame:
    """Linked boundaries (tail_page, tail_par, head_page, head_par) to chains: one goes on where a boundary's tail is the
    head of the one before. Chain ids come from their first member, not from chance."""
    order = ["tail_page", "tail_par"]
    linked = boundaries.where("linked")
    go_on = previous("head_page", doc, order).eqNullSafe(F.col("tail_page")) & previous("head_par", doc, order).eqNullSafe(F.col("tail_par"))
    c = islands(linked, doc, order, ~go_on, "_chain")
    tails = c.groupBy(*doc, "_chain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(F.col("tail_page").alias("page"), F.col("tail_par").alias("par")), F.struct(F.col("head_page").alias("page"), F.col("head_par").alias("par"))))))).alias("members"))
    first = F.col("members")[0]
    return tails.select(*doc, F.substring(F.sha2(F.concat_ws(":", *doc, first["page"], first["par"]), 256), 1, 12).alias("chain_id"), F.posexplode("members").alias("chain_index", "_m")).select(*doc, "chain_id", "chain_index", "_m.page", "_m.par")


def articles(pages: DataFrame, doc: list[str], page: str = "page", role: str = "role") -> DataFrame:
    """Pages that open an article and their followers; pages of no role are in none; leading followers make article 0."""
    some = pages.where(F.col(role).isNotNull() & (F.col(role) != "unassigned"))
    return islands(some, doc, [page], F.col(role) == "opener", "article")


def shifted_columns(members: DataFrame, column: list[str], order: list[str], shift: str = "shift", blocked: str = "blocked") -> DataFrame:
    """Running shift of a column's members, begun anew at blocked ones, which stay."""
    r = islands(members, column, order, F.col(blocked), "_reset")
    w = Window.partitionBy(*column, "_reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("total_shift", F.sum(F.when(F.col(blocked), 0.0).otherwise(F.col(shift))).over(w)).drop("_reset")


def first_violation(members: DataFrame, column: list[str], order: list[str], cap: float) -> DataFrame:
    """The first guard that a moved member breaks: cap, frame, monotone or gap; null if none."""
    above = previous("y_new", column, order)
    why = F.when(F.abs(F.col("y_new") - F.col("y_old")) > cap, "cap").when(F.col("y_new") < F.col("y_floor"), "frame").when(F.col("y_new") > above, "monotone").when(above - F.col("y_new") < F.col("height"), "gap")
    return members.withColumn("violation", why)


def chunks(rows: DataFrame, scope: list[str], order: list[str], n: int, name: str = "chunk") -> DataFrame:
    """n rows a chunk, in order."""
    return rows.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1) / n))


def overlap_histogram(lines: DataFrame, scope: list[str], low: Column, high: Column, step: float = 0.25) -> DataFrame:
    """(scope, at, depth): how many intervals hold each step, from +1 and -1 events and a running sum."""
    at = lambda v: F.floor(v / step).cast("long")
    events = lines.select(*scope, F.explode(F.array(F.struct(at(low).alias("at"), F.lit(1).alias("d")), F.struct((at(high) + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*scope, "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*scope).orderBy("at")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.select(*scope, "at", depth.alias("depth"), (F.lead("at").over(w) - F.col("at")).alias("steps"))


def top_n(rows: DataFrame, scope: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def leading_run(chars: DataFrame, paragraph: list[str], order: str, size: str, tolerance: float = 0.05) -> DataFrame:
    """The characters before the first whose size differs from the paragraph's first."""
    w = Window.partitionBy(*paragraph).orderBy(order)
    other = F.abs(F.col(size) - F.first(size).over(w)) > tolerance
    end = F.min(F.when(F.col("_other"), F.col(order))).over(Window.partitionBy(*paragraph))
    return chars.withColumn("_other", other).withColumn("_end", end).where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_other", "_end")


def running_title(rows: DataFrame, scope: list[str], order: list[str], title: Column) -> DataFrame:
    """Each row with the last title at or before it."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("title", F.last(title, ignorenulls=True).over(w))


def throttled(events: DataFrame, key: list[str], ts: str, seconds: float) -> DataFrame:
    """Events at least that long after the last one kept of their key: a fold over the ordered times of a key."""
    times = events.groupBy(*key).agg(F.array_sort(F.collect_set(ts)).alias("_ts"))
    none = F.lit(None).cast("timestamp")
    keep = F.aggregate("_ts", F.struct(F.array().cast("array<timestamp>").alias("kept"), none.alias("last")), lambda s, t: F.when(s["last"].isNull() | (t.cast("double") - s["last"].cast("double") >= seconds), F.struct(F.concat(s["kept"], F.array(t)).alias("kept"), t.alias("last"))).otherwise(s), lambda s: s["kept"])
    return times.select(*key, F.explode(keep).alias(ts))
