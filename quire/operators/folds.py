"""Operators whose next step depends on what the last one made: folds over the ordered rows of one page, chain or document.

A group is one page, chain or document and never a key that grows with the corpus. SQL aggregate() is used where the state
is small; otherwise sorted rows stream through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st


def ordered(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """rows with each scope's in one partition, one after another and in order (nulls last)."""
    return rows.repartition(*scope).sortWithinPartitions(*scope, *[F.col(c).asc_nulls_last() for c in order])


def edges(table: pa.Table, scope: list[str]) -> list[int]:
    """Where a scope's rows begin in rows that are sorted by scope."""
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in scope:
        x = table.column(c).combine_chunks()
        a, b = x.slice(1), x.slice(0, max(0, len(x) - 1))
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        change |= pc.coalesce(pc.not_equal(a, b), one_null).to_numpy(zero_copy_only=False).astype(bool)
    return [0, *(np.flatnonzero(change) + 1).tolist()]


def scopes(batches: Iterator[pa.RecordBatch], scope: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole scopes, with the places where these begin; a scope may come in several batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        at = edges(table, scope)
        held = table.slice(at[-1])
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
    if held is not None and held.num_rows:
        yield held, [0]


def folded(rows: DataFrame, scope: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | st.StructType) -> DataFrame:
    """f over each scope's rows in order. Scopes stream through a task, many to a batch: one costs its rows and no more."""
    names = schema.fieldNames() if isinstance(schema, st.StructType) else st._parse_datatype_string(schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            k = frame[scope]
            before = k.shift()
            change = ((k != before) & ~(k.isna() & before.isna())).any(axis=1).to_numpy()
            change[:1] = True
            at = np.flatnonzero(change).tolist()
            held = frame.iloc[at[-1] :] if at else None
            if len(at) > 1:
                yield pd.concat([f(frame.iloc[a:z].reset_index(drop=True))[names] for a, z in zip(at, at[1:], strict=False)])
        if held is not None and len(held):
            yield f(held.reset_index(drop=True))[names]

    return ordered(rows, scope, order).mapInPandas(run, schema)


def _numbered(rows: DataFrame, scope: list[str], order: list[str], name: str, f: Callable[[pd.DataFrame], list]) -> DataFrame:
    """rows with a number each, which f gives for a scope's rows in order."""
    rest = [c for c in rows.columns if c != name]
    schema = st.StructType([*rows.select(*rest).schema.fields, st.StructField(name, st.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in scopes(batches, scope):
            frame, out = table.to_pandas(), []
            for a, z in zip(at, [*at[1:], table.num_rows], strict=True):
                out += f(frame.iloc[a:z].reset_index(drop=True))
            yield from table.append_column(name, pa.array(out, pa.int64())).to_batches()

    return ordered(rows.select(*rest), scope, order).mapInArrow(run, schema)


def folded_sql(rows: DataFrame, scope: list[str], order: list[str], first: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows with `name`, the field n of a state that aggregate() carries over each scope's rows in order: one array a scope, in
    generated code. The state has the fields n and out (array); step(state, row) gives the next one but for out."""
    packed = rows.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("_row")))).alias("_rows"))
    numbers = F.aggregate("_rows", first, step, lambda s: s["out"])
    return packed.select(F.explode(F.arrays_zip(F.col("_rows._row").alias("row"), numbers.alias("n"))).alias("_z")).select("_z.row.*", F.col("_z.n").alias(name))


def batched(rows: DataFrame, scope: list[str], order: list[str], tokens: str, most_tokens: int = 200, most_rows: int = 5, name: str = "batch") -> DataFrame:
    """Batches that are closed once a row has taken them past either limit, that row included."""
    zero = F.lit(0).cast("long")

    def step(s: Column, row: Column) -> Column:
        total, k = s["total"] + row["_row"][tokens].cast("long"), s["k"] + 1
        full = (total > most_tokens) | (k > most_rows)
        return F.struct(F.when(full, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(full, zero).otherwise(total).alias("total"), F.when(full, zero).otherwise(k).alias("k"), F.concat(s["out"], F.array(s["n"])).alias("out"))

    first = F.struct(zero.alias("n"), zero.alias("total"), zero.alias("k"), F.array().cast("array<long>").alias("out"))
    return folded_sql(rows.drop(name), scope, order, first, step, name)


def seeded_bands(rows: DataFrame, scope: list[str], order: list[str], value: str, gap: float, name: str = "band") -> DataFrame:
    """Bands of ascending values; one begins where a value is more than `gap` past the band's first."""

    def step(s: Column, row: Column) -> Column:
        v = row["_row"][value].cast("double")
        new = s["first"].isNull() | (v - s["first"] > gap)
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(n.alias("n"), F.when(new, v).otherwise(s["first"]).alias("first"), F.concat(s["out"], F.array(n)).alias("out"))

    first = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(None).cast("double").alias("first"), F.array().cast("array<long>").alias("out"))
    return folded_sql(rows.drop(name), scope, [value, *order], first, step, name)


def style_runs(rows: DataFrame, scope: list[str], order: list[str], font: str = "font_id", size: str = "font_size", tolerance: float = 0.02, name: str = "run") -> DataFrame:
    """Runs in the style of the run's first character (sizes within a tolerance); formulas cut runs."""
    formula = "is_formula" in rows.columns

    def step(s: Column, row: Column) -> Column:
        f, v = row["_row"][font].cast("string"), row["_row"][size].cast("double")
        cut = F.coalesce(row["_row"]["is_formula"], F.lit(False)) if formula else F.lit(False)
        new = (s["n"] < 0) | cut | s["cut"] | ~f.eqNullSafe(s["font"]) | (F.abs(v - s["size"]) > tolerance)
        keep = lambda now, was: F.when(new, now).otherwise(was)
        n = keep(s["n"] + 1, s["n"])
        return F.struct(n.alias("n"), keep(f, s["font"]).alias("font"), keep(v, s["size"]).alias("size"), keep(cut, s["cut"]).alias("cut"), F.concat(s["out"], F.array(n)).alias("out"))

    first = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"), F.lit(False).alias("cut"), F.array().cast("array<long>").alias("out"))
    return folded_sql(rows.drop(name), scope, order, first, step, name)


def line_bands(rows: DataFrame, scope: list[str], order: list[str], ratio: float = 0.5, name: str = "band") -> DataFrame:
    """First band whose first box shares `ratio` of both heights, else a new one (columns y, y2)."""

    def number(g):
        out, seeds = [], []
        for lo, hi in zip(g["y"], g["y2"], strict=True):
            for i, (a, b) in enumerate(seeds):
                shared = min(hi, b) - max(lo, a)
                if shared >= ratio * max(hi - lo, b - a):
                    out.append(i)
                    break
            else:
                seeds.append((lo, hi))
                out.append(len(seeds) - 1)
        return out

    return _numbered(rows, scope, order, name, number)


def columns_of(rows: DataFrame, scope: list[str], order: list[str], ratio: float = 0.5, name: str = "column") -> DataFrame:
    """First column whose span, which grows, shares `ratio` of the wider width (columns x, x2)."""

    def number(g):
        out, spans = [], []
        for lo, hi in zip(g["x"], g["x2"], strict=True):
            for i, (a, b) in enumerate(spans):
                if min(hi, b) - max(lo, a) >= ratio * max(hi - lo, b - a) > 0:
                    spans[i] = (min(a, lo), max(b, hi))
                    out.append(i)
                    break
            else:
                spans.append((lo, hi))
                out.append(len(spans) - 1)
        return out

    return _numbered(rows, scope, order, name, number)


def merged_lines(rows: DataFrame, scope: list[str], order: list[str], overlap: float = 0.3, name: str = "line") -> DataFrame:
    """Clusters of lines joined while their shared height passes `overlap` of the smaller, or their middles are closer than
    the mean character height; ranges grow until nothing changes (columns y, y2, char_height)."""

    def number(g):
        mean = g["char_height"].mean()
        groups = [[[i], lo, hi] for i, (lo, hi) in enumerate(zip(g["y"], g["y2"], strict=True))]
        moved = True
        while moved:
            moved = False
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    (a, lo, hi), (b, lo2, hi2) = groups[i], groups[j]
                    small = min(hi - lo, hi2 - lo2)
                    if (small > 0 and (min(hi, hi2) - max(lo, lo2)) / small > overlap) or abs(lo + hi - lo2 - hi2) / 2 < mean:
                        groups[i] = [a + b, min(lo, lo2), max(hi, hi2)]
                        del groups[j]
                        moved = True
                        break
                if moved:
                    break
        of = {i: n for n, grp in enumerate(sorted(groups, key=lambda x: min(x[0]))) for i in grp[0]}
        return [of[i] for i in range(len(g))]

    return _numbered(rows, scope, order, name, number)


def separated(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Overlapping neighbours of one form, none within the other, cut at the middle of what they share, less and plus one;
    as many passes as there are rows, squared, at most (columns x, y, x2, y2, xobj_id)."""

    def cut(g):
        y, y2, x, x2, form = (g[c].tolist() for c in ("y", "y2", "x", "x2", "xobj_id"))
        for _ in range(len(g) ** 2):
            moved = False
            for i in range(len(g)):
                for j in range(i + 1, len(g)):
                    if form[i] != form[j] or min(x2[i], x2[j]) <= max(x[i], x[j]) or min(y2[i], y2[j]) <= max(y[i], y[j]):
                        continue
                    if (y[i] <= y[j] and y2[j] <= y2[i]) or (y[j] <= y[i] and y2[i] <= y2[j]):
                        continue
                    up, down = (i, j) if y2[i] > y2[j] else (j, i)
                    mid = (y[up] + y2[down]) / 2
                    y[up], y2[down], moved = mid + 1, mid - 1, True
            if not moved:
                break
        return g.assign(y=y, y2=y2)

    return folded(rows, scope, order, cut, rows.schema)


def greedy_pairs(rows: DataFrame, scope: list[str], order: list[str], gap: float = 20.0) -> DataFrame:
    """Neighbours whose next top is more than `gap` higher (a column ends between them), each row in one pair at most."""

    def pair(g):
        out, used = [], set()
        for i in range(len(g) - 1):
            if i not in used and g["y2"][i + 1] - g["y2"][i] > gap:
                used |= {i, i + 1}
                out.append([*(g[c][0] for c in scope), int(g["idx"][i]), int(g["idx"][i + 1])])
        return pd.DataFrame(out, columns=[*scope, "first", "second"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return folded(rows, scope, order, pair, ", ".join([*(f"{c} {kinds[c]}" for c in scope), "first long", "second long"]))


def matched_areas(source: DataFrame, produced: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """In source order, each element takes the free produced one whose area is nearest in ratio (columns idx, area)."""
    schema = ", ".join([*(f"{c} {dict(source.dtypes)[c]}" for c in page), "source_idx long", "produced_idx long", "ratio double"])

    def match(a, b):
        out, free = [], {int(i): s for i, s in zip(b["idx"], b["area"], strict=True)}
        for i, s in sorted(zip(a["idx"], a["area"], strict=True)):
            best = max(((min(s, t) / max(s, t) if max(s, t) > 0 else 0.0, -j) for j, t in free.items()), default=None)
            if best and best[0] >= least:
                del free[-best[1]]
                out.append([*(a[c].iloc[0] for c in page), int(i), -best[1], best[0]])
        return pd.DataFrame(out, columns=[*page, "source_idx", "produced_idx", "ratio"])

    return source.groupBy(*page).cogroup(produced.groupBy(*page)).applyInPandas(match, schema)


def stitched(rows: DataFrame, scope: list[str], order: list[str], most: int = 40, terminals: str = ".!?。！？…", name: str = "unit") -> DataFrame:
    """Left to right: a fragment joins what stands before it if that does not end a sentence and either is short; what was
    made is the next left side. Barrier rows (column barrier) stand alone."""

    def number(g):
        out, unit, left = [], -1, None
        for t, wall in zip(g["text"], g["barrier"], strict=True):
            if left is None or wall or left[1] or left[0].rstrip("\"'”’)] ")[-1:] in terminals or min(len(left[0]), len(t)) > most:
                unit, left = unit + 1, (t, wall)
            else:
                left = (left[0] + " " + t, False)
            out.append(unit)
        return out

    return _numbered(rows, scope, order, name, number)


def split_at_commas(text: Column) -> Column:
    """Parts between commas outside brackets; a bracket that closes nothing doesn't count."""
    step = F.aggregate(
        F.split(text, ""),
        F.struct(F.array(F.lit("")).alias("parts"), F.lit(0).alias("depth")),
        lambda s, c: F.struct(
            F.when((c == ",") & (s["depth"] == 0), F.concat(s["parts"], F.array(F.lit("")))).otherwise(F.concat(F.slice(s["parts"], 1, F.size(s["parts"]) - 1), F.array(F.concat(F.element_at(s["parts"], -1), c)))).alias("parts"),
            F.when(c.isin("(", "[", "{"), s["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
        ),
    )
    return step["parts"]


def joined_members(members: Column, spaceless: bool = False) -> Column:
    """array<string> of a chain's members as one text: a hyphen at an end goes, else a space (none in spaceless scripts)."""
    sep = "" if spaceless else " "
    join = lambda s, m: F.when(s == "", m).when(s.rlike(r"\p{L}-$") & m.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(s, "-$", ""), m)).otherwise(F.concat(F.rtrim(s), F.lit(sep), m))
    return F.aggregate(F.filter(members, lambda m: F.trim(m) != ""), F.lit(""), join)


def redistributed(chains: DataFrame, key: str = "chain_id", translation: str = "translation", lengths: str = "lengths") -> DataFrame:
    """(key, chain_index, start, end, text): a translation cut into as many pieces as there were members, near their shares
    of the source: after a sentence if one ends within a quarter of a piece, else after a clause, else at a space, else
    where the share says. Pieces lie end to end and join to the translation again; with fewer characters than members the
    last pieces are empty."""
    import re

    def cuts(text: str, sizes: list[int]) -> list[int]:
        total, n, at, out = sum(sizes) or 1, len(text), 0, []
        stops = [[m.end() for m in re.finditer(p, text)] for p in (r"[.!?。！？…]+[\"'”’)\]]*\s*", r"[,;:，；：、]\s*", r"\s+")]
        done = 0
        for s in sizes[:-1]:
            done += s
            want, room = n * done / total, max(1.0, n * s / total / 4)
            near = next((min(c, key=lambda x: (abs(x - want), x)) for c in ([x for x in k if at < x < n and abs(x - want) <= room] for k in stops) if c), None)
            at = max(at, min(n, near if near is not None else round(want)))
            out.append(at)
        return [*out, n]

    def run(frames):
        for f in frames:
            out = []
            for k, t, sizes in zip(f[key], f[translation], f[lengths], strict=True):
                a = 0
                for i, z in enumerate(cuts(t or "", list(sizes))):
                    out.append((k, i, a, z, (t or "")[a:z]))
                    a = z
            yield pd.DataFrame(out, columns=[key, "chain_index", "start", "end", "text"])

    kind = dict(chains.dtypes)[key]
    return chains.select(key, translation, lengths).mapInPandas(run, f"{key} {kind}, chain_index long, start long, end long, text string")


def components_of_pages(chains: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, article, merged): articles that one chain touches are one, named by the least (columns article, chain_id)."""

    def merge(g):
        parent = {a: a for a in g["article"]}

        def root(a):
            while parent[a] != a:
                a = parent[a]
            return a

        touched: dict = {}  # a chain's first article
        for a, c in zip(g["article"], g["chain_id"], strict=True):
            if not pd.isna(c):
                one, two = sorted((root(a), root(touched.setdefault(c, a))))
                parent[two] = one
        key = [g[c].iloc[0] for c in doc]
        return pd.DataFrame([(*key, a, root(a)) for a in sorted(parent)], columns=[*doc, "article", "merged"])

    kinds = dict(chains.dtypes)
    return folded(chains, doc, ["article"], merge, ", ".join([*(f"{c} {kinds[c]}" for c in doc), f"article {kinds['article']}", f"merged {kinds['article']}"]))


def suppressed_duplicates(rows: DataFrame, scope: list[str], order: list[str], iou: float = 0.5, alike: float = 0.9) -> DataFrame:
    """Headings without those that repeat a kept one's text on its place; the larger stays, of equals the earlier."""
    from quire.functions.text import similarity

    def keep(g):
        size = (g["x2"] - g["x"]) * (g["y2"] - g["y"])
        kept: list[int] = []
        for i in sorted(range(len(g)), key=lambda i: (-size[i], i)):
            for j in kept:
                w = min(g["x2"][i], g["x2"][j]) - max(g["x"][i], g["x"][j])
                h = min(g["y2"][i], g["y2"][j]) - max(g["y"][i], g["y"][j])
                both = max(w, 0) * max(h, 0)
                if both and both / (size[i] + size[j] - both) >= iou and similarity.plain(g["text"][i], g["text"][j]) >= alike:
                    break
            else:
                kept.append(i)
        return g.iloc[sorted(kept)]

    return folded(rows, scope, order, keep, rows.schema)


def region_count(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Regions of differing blocks (row, col) that touch at sides or corners."""

    def count(g):
        left, n = set(zip(g["row"], g["col"], strict=True)), 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                r, c = todo.pop()
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
        return pd.DataFrame([[*(g[c].iloc[0] for c in page), n]], columns=[*page, "regions"])

    kinds = dict(blocks.dtypes)
    return folded(blocks, page, ["row", "col"], count, ", ".join([*(f"{c} {kinds[c]}" for c in page), "regions long"]))


def peeled_renderings(cands: DataFrame, region: list[str]) -> DataFrame:
    """(region, term, rendering, size): again and again the substring that most of the paragraphs left have (two at least,
    the longest of equals, then by text), whose paragraphs then go (columns term, paragraph, candidate)."""

    def peel(g):
        out, has = [], {}
        for p, c in zip(g["paragraph"], g["candidate"], strict=True):
            has.setdefault(c, set()).add(p)
        while has:
            c = min(has, key=lambda c: (-len(has[c]), -len(c), c))
            own = has[c]
            if len(own) < 2:
                break
            out.append((*(g[k].iloc[0] for k in [*region, "term"]), c, len(own)))
            has = {k: left for k, v in has.items() if (left := v - own)}
        return pd.DataFrame(out, columns=[*region, "term", "rendering", "size"])

    kinds = dict(cands.dtypes)
    return folded(cands, [*region, "term"], ["paragraph", "candidate"], peel, ", ".join([*(f"{c} {kinds[c]}" for c in [*region, "term"]), "rendering string, size long"]))


def laid_lines(units: DataFrame, paragraph: list[str], order: list[str], measure: str, name: str = "line") -> DataFrame:
    """Greedy lines: a unit goes to the next line if it passes the measure, unless it may hang (columns width, hangs); a
    line breaks only before units that may begin one (column can_break)."""

    def number(g):
        out, line, at, limit = [], 0, 0.0, g[measure].iloc[0]
        start = 0  # the first unit after the last place to break
        for i, (w, hang, brk) in enumerate(zip(g["width"], g["hangs"], g["can_break"], strict=True)):
            if brk:
                start = i
            out.append(line)
            at += w
            if at > limit and not hang and (start > 0 and out[start - 1] == line if start else False):
                line += 1
                for j in range(start, i + 1):
                    out[j] = line
                at = float(g["width"].iloc[start : i + 1].sum())
        return out

    return _numbered(units, paragraph, order, name, number)


def optimal_scale(units: DataFrame, paragraph: list[str], measure: str, room: str, height: str, least: float = 0.1) -> DataFrame:
    """(paragraph, scale, lines): the largest scale of 1, 0.95 ... 0.6, 0.5 ... 0.1 at which the widths fill no more lines
    than the room holds; the least one where none does."""
    import math

    steps = [round(1 - 0.05 * i, 2) for i in range(9)] + [0.5, 0.4, 0.3, 0.2, 0.1]
    total = units.groupBy(*paragraph).agg(F.sum("width").alias("_w"), F.first(measure).alias("_m"), F.first(room).alias("_r"), F.first(height).alias("_h"))
    fits = lambda s: F.ceil(F.col("_w") * s / F.col("_m")) * F.col("_h") * s <= F.col("_r")
    scale = F.coalesce(*[F.when(fits(s), F.lit(s)) for s in steps if s >= least], F.lit(least))
    assert math.isclose(steps[8], 0.6)
    return total.select(*paragraph, scale.alias("scale")).join(total, paragraph).select(*paragraph, "scale", F.ceil(F.col("_w") * F.col("scale") / F.col("_m")).alias("lines"))
