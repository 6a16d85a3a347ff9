"""Geometry of boxes (struct<x, y, x2, y2: double>, origin at the bottom left) and affine matrices, as column expressions.

Null means that something can't be measured; it never stands for zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x: double, y: double, x2: double, y2: double>"
SIDES = ("left", "bottom", "right", "top")


def box(x, y, x2, y2) -> Column:
    c = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(x2).alias("x2"), c(y2).alias("y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x"]


def height(b: Column) -> Column:
    return b["y2"] - b["y"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def x_shared(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))


def y_shared(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return x_shared(a, b) * y_shared(a, b)


def over(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.when(part.isNotNull() & whole.isNotNull(), 0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by the area of the union."""
    return over(intersection(a, b), area(a) + area(b) - intersection(a, b))


def overlap_over_first(a: Column, b: Column) -> Column:
    """Shared area by the first box's own."""
    return over(intersection(a, b), area(a))


def coverage(a: Column, b: Column) -> Column:
    """Shared area by the smaller box's own."""
    return over(intersection(a, b), F.least(area(a), area(b)))


def y_overlap_over_first(a: Column, b: Column) -> Column:
    return over(y_shared(a, b), height(a))


def y_overlap_over_smaller(a: Column, b: Column) -> Column:
    """Null where the second box has no height but the first has: there is nothing to divide by."""
    return F.when(height(a) <= 0, 0.0).when(height(b) > 0, y_shared(a, b) / F.least(height(a), height(b)))


def x_overlap_over_narrower(a: Column, b: Column) -> Column:
    return over(x_shared(a, b), F.least(width(a), width(b)))


def same_measure(a: Column, b: Column, ratio: float) -> Column:
    """Shared width is at least `ratio` of the wider box's."""
    return over(x_shared(a, b), F.greatest(width(a), width(b))) >= ratio


def inset(b: Column, ratio: float) -> Column:
    dx, dy = width(b) * ratio, height(b) * ratio
    return box(b["x"] + dx, b["y"] + dy, b["x2"] - dx, b["y2"] - dy)


def overflow(b: Column, bounds: Column) -> Column:
    """Distance past each side of bounds: struct<left, bottom, right, top>, never negative."""
    past = (bounds["x"] - b["x"], bounds["y"] - b["y"], b["x2"] - bounds["x2"], b["y2"] - bounds["y2"])
    return F.struct(*[F.greatest(p, F.lit(0.0)).alias(s) for p, s in zip(past, SIDES, strict=True)])


def worst_overflow(amounts: Column, frame: Column) -> Column:
    """struct<side, points, ratio> of the side that is passed most (the first named of equals); null if none is."""
    each = F.array(*[F.struct(amounts[s].alias("points"), F.lit(-i).alias("rank"), F.lit(s).alias("side"), over(amounts[s], width(frame) if s in ("left", "right") else height(frame)).alias("ratio")) for i, s in enumerate(SIDES)])
    top = F.array_max(each)
    return F.when(top["points"] > 0, F.struct(top["side"].alias("side"), top["points"].alias("points"), top["ratio"].alias("ratio")))


def fit(b: Column, bounds: Column) -> Column:
    """The largest scale up to 1 and the slide that bring b into bounds: struct<scale, dx, dy>."""
    scale = F.least(F.lit(1.0), width(bounds) / F.nullif(width(b), F.lit(0.0)), height(bounds) / F.nullif(height(b), F.lit(0.0)))

    def slide(low, high, lo, size):
        return F.when(lo < low, low - lo).when(lo + size > high, high - (lo + size)).otherwise(0.0)

    return F.struct(scale.alias("scale"), slide(bounds["x"], bounds["x2"], b["x"], width(b) * scale).alias("dx"), slide(bounds["y"], bounds["y2"], b["y"], height(b) * scale).alias("dy"))


def escape_distances(b: Column, other: Column, target: float) -> Column:
    """How far b must slide each way until the shared area is `target` of the smaller one: struct<left, right, down, up>."""
    allowed = F.least(area(b), area(other)) * target
    room_x = allowed / F.nullif(y_shared(b, other), F.lit(0.0))  # shared width that may stay
    room_y = allowed / F.nullif(x_shared(b, other), F.lit(0.0))
    need = lambda d: F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0))
    return F.struct(need(b["x2"] - other["x"] - room_x).alias("left"), need(other["x2"] - b["x"] - room_x).alias("right"), need(b["y2"] - other["y"] - room_y).alias("down"), need(other["y2"] - b["y"] - room_y).alias("up"))


def on_unit_page(b: Column, frame: Column) -> Column:
    """b in shares of the frame; null on a frame without area."""
    w, h = F.nullif(width(frame), F.lit(0.0)), F.nullif(height(frame), F.lit(0.0))
    return F.when((width(frame) > 0) & (height(frame) > 0), box((b["x"] - frame["x"]) / w, (b["y"] - frame["y"]) / h, (b["x2"] - frame["x"]) / w, (b["y2"] - frame["y"]) / h))


def alignment_coordinates(b: Column) -> Column:
    """left, x centre, right, top, y centre, bottom."""
    return F.array(b["x"], (b["x"] + b["x2"]) / 2, b["x2"], b["y2"], (b["y"] + b["y2"]) / 2, b["y"])


def translation_and_scale(old: Column, new: Column) -> Column:
    """The move and the lesser scale from one box to another: struct<dx, dy, scale>."""
    scale = F.least(over(width(new), width(old)), over(height(new), height(old)))
    return F.struct((new["x"] - old["x"]).alias("dx"), (new["y"] - old["y"]).alias("dy"), scale.alias("scale"))


def bounding_box(b: Column) -> Column:
    """Aggregate: the union of boxes."""
    return F.struct(F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x2"]).alias("x2"), F.max(b["y2"]).alias("y2"))


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef", strict=True)])


def multiply(m: Column, n: Column) -> Column:
    """m after n, for row vectors (x, y, 1)."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def moved(m: Column, dx: Column, dy: Column, scale: Column) -> Column:
    """m, then scaled and moved."""
    return multiply(m, matrix(scale, 0.0, 0.0, scale, dx, dy))


def decompose(m: Column) -> Column:
    """struct<dx, dy, rotation (degrees), scale_x, scale_y, shear>, with the x axis kept unsheared."""
    sx = F.sqrt(m["a"] * m["a"] + m["b"] * m["b"])
    det = m["a"] * m["d"] - m["b"] * m["c"]
    return F.struct(m["e"].alias("dx"), m["f"].alias("dy"), F.degrees(F.atan2(m["b"], m["a"])).alias("rotation"), sx.alias("scale_x"), (det / F.nullif(sx, F.lit(0.0))).alias("scale_y"), ((m["a"] * m["c"] + m["b"] * m["d"]) / F.nullif(det, F.lit(0.0))).alias("shear"))


def clipped_log(x: Column, most: float = 0.999999) -> Column:
    """-log(1 - x), x kept in 0..most."""
    return -F.log(1 - F.least(F.greatest(x, F.lit(0.0)), F.lit(most)))


def combined(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted signals by the weights above zero of those that are there, kept in 0..1; null if none is there.

    A penalty (a weight below zero) takes part in the sum and not in what it is divided by.
    """
    zero = F.lit(0.0)
    total = sum((F.coalesce(v * weights[k], zero) for k, v in values.items()), zero)
    there = sum((F.when(v.isNotNull(), max(weights[k], 0.0)).otherwise(0.0) for k, v in values.items()), zero)
    return F.when(there > 0, F.least(F.greatest(total / there, zero), F.lit(1.0)))


def shares(lengths: Column) -> Column:
    """Each of an array by their sum; null if that is 0."""
    total = F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(lengths, lambda v: v / total))


def half_even(x: Column, digits: int) -> Column:
    """Rounds halves to the even digit, as Python does."""
    return F.bround(x, digits)


def mean_of(*halves: Column) -> Column:
    """Mean of those that are not null."""
    there = sum((h.isNotNull().cast("int") for h in halves), F.lit(0))
    return sum((F.coalesce(h, F.lit(0.0)) for h in halves), F.lit(0.0)) / F.nullif(there, F.lit(0))


def soft_prior(confidence: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(confidence, F.lit(low)), F.lit(high))
