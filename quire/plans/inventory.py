"""More registered queries: text and geometry functions, records, joins, windows, passes, services, sources and streams.

Lines of documents and their made-up boxes are those of quire.plans.catalog; turns of conversations play paragraphs, parts
play headings, fonts and settings, line items play characters.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import records as R
from quire.functions import text as T
from quire.operators import aggregates as A
from quire.operators import characters as C
from quire.operators import folds, passes, services
from quire.operators import joins as J
from quire.operators import windows as W
from quire.plans.catalog import AREA, BOXES, LINES, PAIR, REGIONS, boxed, lines, query, regions, table
from quire.sources import content, files, pdf
from quire.streaming import events as S

# Text.


@query("with c as (select p_partkey, list_transform(string_split(p_name, ' '), lambda w: case when length(w) % 2 = p_size % 2 then '(cid:' || length(w) || ')' else w end) as chars from part) select p_partkey from c where len(list_filter(chars, lambda x: regexp_matches(x, '^\\(cid:\\d+\\)$'))) > len(chars) * 0.8")
def cid_paragraphs(spark, d):
    w = lambda x: F.when(F.length(x) % 2 == F.col("p_size") % 2, F.concat(F.lit("(cid:"), F.length(x).cast("string"), F.lit(")"))).otherwise(x)
    return table(spark, d, "part").where(T.mostly_cid(F.transform(F.split("p_name", " "), w))).select("p_partkey")


@query(f"with {LINES} select doc_id, line, substring(txt, 1, 1) in ('•','◦','‣','▪','■','□','●','○','*','-','–','·') as item, txt is not distinct from lag(txt) over (partition by doc_id order by line) as unchanged from lines")
def list_items_and_identity(spark, d):
    before = W.previous("txt", ["doc_id"], ["line"])
    return lines(spark, d).select("doc_id", "line", T.bullet(F.substring("txt", 1, 1)).alias("item"), T.identity_write_back(F.col("txt"), before).alias("unchanged"))


FORMULAS = "formulas as (select p_partkey, case p_partkey % 4 when 0 then p_size || ', ' || p_partkey when 1 then 'x_' || p_size || ', y' when 2 then '[' || p_size || ',' || p_partkey || ']' else p_name end as txt from part)"


def formulas(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 4
    txt = F.when(k == 0, F.concat(size, F.lit(", "), key)).when(k == 1, F.concat(F.lit("x_"), size, F.lit(", y"))).when(k == 2, F.concat(F.lit("["), size, F.lit(","), key, F.lit("]"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", txt.alias("txt"))


@query(f"with {FORMULAS} select p_partkey, regexp_matches(txt, '^[0-9, .]+$') as translatable, contains(txt, ',') and regexp_replace(txt, '[0-9\\[\\],\\s]', '', 'g') <> '' as splittable from formulas")
def formula_kinds(spark, d):
    t = F.col("txt")
    return formulas(spark, d).select("p_partkey", T.translatable_formula(t).alias("translatable"), T.splittable_formula(t).alias("splittable"))


@query(f"with recursive {FORMULAS}, c as (select p_partkey, txt, 1 as i, 0 as depth, 0 as part from formulas union all select p_partkey, txt, i + 1, case when substring(txt, i, 1) in ('(', '[', '{{') then depth + 1 when substring(txt, i, 1) in (')', ']', '}}') then greatest(depth - 1, 0) else depth end, part + case when substring(txt, i, 1) = ',' and depth = 0 then 1 else 0 end from c where i <= length(txt)) select p_partkey, part as idx, coalesce(string_agg(substring(txt, i, 1), '' order by i) filter (where not (substring(txt, i, 1) = ',' and depth = 0)), '') as piece from (select p_partkey, txt, i, depth, part - 0 as part from c) group by p_partkey, part")
def formula_parts(spark, d):
    return formulas(spark, d).select("p_partkey", F.posexplode(folds.split_at_commas(F.col("txt"))).alias("idx", "piece"))


@query("with n as (select n_nationkey as k, replace(n_name, '_', ' ') as t from nation union all select r_regionkey + 100, 'Upper ' || upper(r_name) || ' Land' from region union all select p_partkey + 1000, p_name from part), w as (select k, t, len(regexp_split_to_array(trim(t), '\\s+')) as n from n) select k, case when regexp_matches(trim(t), '^\\p{Lu}[\\p{L}''.-]*(?:\\s+\\p{Lu}[\\p{L}''.-]*)*$') and n between 2 and 5 then 'name_shaped' when length(trim(t)) between 1 and 8 then 'label_shaped' end as shape from w")
def name_shapes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("t"))
    n = n.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("k"), F.concat(F.lit("Upper "), F.upper("r_name"), F.lit(" Land")).alias("t")))
    n = n.unionByName(table(spark, d, "part").select((F.col("p_partkey") + 1000).alias("k"), F.col("p_name").alias("t")))
    return n.select("k", T.name_or_label(F.col("t")).alias("shape"))


@query("with c as (select conv_id, turn, unnest(regexp_extract_all(text || ' 漢字、かな', '(?s).')) as c from conversations) select conv_id, turn, count_if(regexp_matches(c, '^[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ac00}-\\x{d7af}]$'))::bigint as cjk, count_if(contains(',.;:!?，。；：！？、''\"”’)」』》', c))::bigint as hanging, count_if(regexp_matches(c, '^(?:\\s|-|[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ac00}-\\x{d7af}])$'))::bigint as breaks from c group by all")
def character_classes(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split(F.concat("text", F.lit(" 漢字、かな")), "")).alias("c")).where("c != ''")
    c = F.col("c")
    return t.groupBy("conv_id", "turn").agg(F.count_if(T.cjk(c)).alias("cjk"), F.count_if(T.hangs(c)).alias("hanging"), F.count_if(T.breakable(c)).alias("breaks"))


FONTS = "fonts as (select p_partkey, case when p_partkey % 2 = 0 then 'ABCDEF+' else '' end || replace(p_name, ' ', '') || case p_size % 5 when 0 then '-BoldItalic' when 1 then ',Italic' when 2 then '-Regular' when 3 then 'Math' else '' end as font from part)"


def fonts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 5
    tail = F.when(k == 0, "-BoldItalic").when(k == 1, ",Italic").when(k == 2, "-Regular").when(k == 3, "Math").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "ABCDEF+").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("")), tail).alias("font"))


@query(f"with {FONTS} select p_partkey, regexp_replace(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), '(?i)[-,]?(bold|italic|oblique|regular|roman|medium|light|semibold|black|mt|ps)+$', '') as family, regexp_matches(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), 'Math$') as formula from fonts")
def font_names(spark, d):
    f = F.col("font")
    return fonts(spark, d).select("p_partkey", T.font_family(f).alias("family"), T.formula_font(f, "Math$").alias("formula"))


@query("select conv_id, turn, length(regexp_replace(text || chr(7) || chr(10), '\\p{Cc}', '', 'g'))::int as clean, length(regexp_replace(text, '\\s', '', 'g'))::int as legible, substring(text, 1, 20) as short from conversations")
def cleaned_turns(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(T.without_controls(F.concat(t, F.lit("\x07\n")))).alias("clean"), T.legible(t).alias("legible"), T.abbreviated(t, 20).alias("short"))


@query("select conv_id, turn, case when turn % 3 = 0 then text else trim(text) end as answer from conversations where turn % 3 <> 0 union all select conv_id, turn, trim(text) from conversations where turn % 3 = 0")
def unfenced_replies(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", T.unfenced(F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" ```json\n"), F.trim("text"), F.lit("\n``` "))).otherwise(F.col("text"))).alias("answer"))


@query("select page_id, length(regexp_replace(regexp_replace(html || '{v12}x', '<[^<>]*>', '', 'g'), '\\{v\\d+\\}', '', 'g'))::int as n from pages")
def unmarked_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.without_markup(F.concat("html", F.lit("{v12}x")))).alias("n"))


@query("select doc_id, len(regexp_extract_all(text, '\\p{Latin}'))::int as latin, len(regexp_extract_all(text, '\\p{Han}'))::int as han from documents")
def script_letters(spark, d):
    return table(spark, d, "documents").select("doc_id", T.letters(F.col("text"), "Latin").alias("latin"), T.letters(F.col("text"), "Han").alias("han"))


@query("select p_partkey, 'Part ' || p_name || ' of ' || p_brand || ', size ' || p_size as prompt from part")
def rendered_prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", T.rendered("Part {name} of {brand}, size {size}", {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("prompt"))


@query("select c_custkey, case c_nationkey % 3 when 0 then c_name when 1 then coalesce(nullif(c_mktsegment, 'FURNITURE'), c_name) else case when c_mktsegment = 'FURNITURE' then c_name else c_mktsegment || ' (' || c_name || ')' end end as rendering from customer")
def policy_renderings(spark, d):
    k = F.col("c_nationkey") % 3
    policy = F.when(k == 0, "keep").when(k == 1, "translate").otherwise("both")
    return table(spark, d, "customer").select("c_custkey", T.policy_rendering(F.col("c_name"), F.nullif("c_mktsegment", F.lit("FURNITURE")), policy).alias("rendering"))


@query("select conv_id, turn, case when length(text) % 2 = 0 then substring(text, 1, 10) || ' end' else substring(text, 1, 10) || ' (' || substring(text, 1, 10) || 'x) end' end as folded from conversations where regexp_matches(substring(text, 1, 10), '^[A-Za-z]+ [a-z ]+$') and not regexp_matches(substring(text, 1, 10), ' $')")
def folded_parentheses(spark, d):
    t = table(spark, d, "conversations").withColumn("h", F.substring("text", 1, 10)).where("h rlike '^[A-Za-z]+ [a-z ]+$' and not h rlike ' $'")
    both = F.when(F.length("text") % 2 == 0, F.concat("h", F.lit(" ("), "h", F.lit(") end"))).otherwise(F.concat("h", F.lit(" ("), "h", F.lit("x) end")))
    return t.select("conv_id", "turn", T.folded_parens(both).alias("folded"))


@query("select p_partkey, case when p_size % 3 = 0 then 'none' when p_size % 3 = 1 then 'fracture' when p_name = reverse(p_name) then 'fracture' else 'order' end as fault from part")
def audited_bands(spark, d):
    k = F.col("p_size") % 3
    other = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.reverse("p_name"))
    return table(spark, d, "part").select("p_partkey", T.band_fault(F.col("p_name"), other).alias("fault"))


@query("with t as (select p_partkey, replace(p_name, ' ', '') as a from part) select p_partkey, round(case when p_partkey % 2 = 0 then 1.0 else 2.0 * length(a) / (2 * length(a) + 5) end, 6)::double as alike from t")
def text_similarity(spark, d):
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.concat("p_name", F.lit("01234")))
    return table(spark, d, "part").select("p_partkey", F.round(T.similarity(F.col("p_name"), other), 6).alias("alike"))


@query("with t as (select conv_id, turn, text || chr(8) || '\\' || ' end' as s from conversations) select conv_id, turn, replace(replace(s, '\\', '\\u005c'), chr(8), '\\u0008') as carried, s as back from t")
def carried_text(spark, d):
    s = F.concat("text", F.lit("\x08\\ end"))
    t = table(spark, d, "conversations").select("conv_id", "turn", T.escaped(s).alias("carried"))
    return t.withColumn("back", T.unescaped(F.col("carried")))


# Geometry: a line's box and the next one's, which is moved and widened a little.

NEXT = f"{BOXES}, pairs as (select doc_id, line, x as ax, y as ay, x2 as ax2, y2 as ay2, x + n % 7 as bx, y - n % 9 as b_y, x2 + n % 11 as bx2, y2 - n % 5 as by2 from boxes)"
AB = {"i": "greatest(least(ax2, bx2) - greatest(ax, bx), 0) * greatest(least(ay2, by2) - greatest(ay, b_y), 0)", "a": "((ax2 - ax) * (ay2 - ay))", "b": "((bx2 - bx) * (by2 - b_y))", "ys": "greatest(least(ay2, by2) - greatest(ay, b_y), 0)", "xs": "greatest(least(ax2, bx2) - greatest(ax, bx), 0)"}


def pairs(spark: SparkSession, d: str) -> DataFrame:
    b, n = F.col("box"), F.col("n")
    return boxed(spark, d).select("doc_id", "line", b.alias("a"), G.box(b["x"] + n % 7, b["y"] - n % 9, b["x2"] + n % 11, b["y2"] - n % 5).alias("b"))


def rounded(c, digits: int = 6):
    return F.round(c, digits)


@query(f"with {NEXT} select doc_id, line, round({AB['i']} / ({AB['a']} + {AB['b']} - {AB['i']}), 6) as iou, round({AB['i']} / least({AB['a']}, {AB['b']}), 6) as coverage, round({AB['i']} / {AB['a']}, 6) as own from pairs")
def box_overlaps(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("doc_id", "line", rounded(G.iou(a, b)).alias("iou"), rounded(G.coverage(a, b)).alias("coverage"), rounded(G.overlap_over_first(a, b)).alias("own"))


@query(f"with {NEXT} select doc_id, line, round({AB['ys']} / (ay2 - ay), 6) as y_own, round({AB['ys']} / least(ay2 - ay, by2 - b_y), 6) as y_least from pairs")
def vertical_overlaps(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("doc_id", "line", rounded(G.y_overlap_over_first(a, b)).alias("y_own"), rounded(G.y_overlap_over_smaller(a, b)).alias("y_least"))


@query(f"with {NEXT} select doc_id, line, round({AB['xs']} / least(ax2 - ax, bx2 - bx), 6) as x_least, {AB['xs']} / greatest(ax2 - ax, bx2 - bx) >= 0.95 as one_measure from pairs")
def horizontal_overlaps(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("doc_id", "line", rounded(G.x_overlap_over_narrower(a, b)).alias("x_least"), G.same_measure(a, b, 0.95).alias("one_measure"))


@query(f"with {BOXES} select doc_id, line, round(x + 0.1 * (x2 - x), 6) as x, round(y + 0.1 * (y2 - y), 6) as y, round(x2 - 0.1 * (x2 - x), 6) as x2, round(y2 - 0.1 * (y2 - y), 6) as y2 from boxes")
def inset_boxes(spark, d):
    return boxed(spark, d).select("doc_id", "line", G.inset(F.col("box"), 0.1).alias("i")).select("doc_id", "line", *[rounded(F.col(f"i.{c}")).alias(c) for c in ("x", "y", "x2", "y2")])


PAST = "past as (select doc_id, line, unnest(['left', 'bottom', 'right', 'top']) as side, unnest([0, 1, 2, 3]) as k, unnest([greatest(20 - x, 0), greatest(-900 - y, 0), greatest(x2 - 420, 0), greatest(y2 + 20, 0)]) as points, unnest([400.0, 880.0, 400.0, 880.0]) as size from boxes)"


@query(f"with {BOXES}, {PAST} select doc_id, line, side, points, round(points / size, 6) as ratio from past where points > 0 qualify row_number() over (partition by doc_id, line order by points desc, k) = 1")
def overflowing_boxes(spark, d):
    frame = G.box(20, -900, 420, -20)
    o = boxed(spark, d).select("doc_id", "line", G.worst_overflow(G.overflow(F.col("box"), frame), frame).alias("w")).where("w is not null")
    return o.select("doc_id", "line", "w.side", "w.points", rounded(F.col("w.ratio")).alias("ratio"))


@query(f"with {BOXES}, s as (select *, least(1.0, 400 / nullif(x2 - x, 0), 880 / nullif(y2 - y, 0)) as scale from boxes) select doc_id, line, round(scale, 6) as scale, round(case when x < 20 then 20 - x when x + (x2 - x) * scale > 420 then 420 - (x + (x2 - x) * scale) else 0 end, 6) as dx, round(case when y < -900 then -900 - y when y + (y2 - y) * scale > -20 then -20 - (y + (y2 - y) * scale) else 0 end, 6) as dy from s")
def fitted_boxes(spark, d):
    return boxed(spark, d).select("doc_id", "line", G.fit(F.col("box"), G.box(20, -900, 420, -20)).alias("f")).select("doc_id", "line", *[rounded(F.col(f"f.{c}")).alias(c) for c in ("scale", "dx", "dy")])


@query(f"with {NEXT}, r as (select *, least({AB['a']}, {AB['b']}) * 0.2 as allowed, {AB['xs']} as xs, {AB['ys']} as ys from pairs) select doc_id, line, round(greatest(coalesce(ax2 - bx - allowed / nullif(ys, 0), 0), 0), 6) as left_, round(greatest(coalesce(bx2 - ax - allowed / nullif(ys, 0), 0), 0), 6) as right_, round(greatest(coalesce(ay2 - b_y - allowed / nullif(xs, 0), 0), 0), 6) as down, round(greatest(coalesce(by2 - ay - allowed / nullif(xs, 0), 0), 0), 6) as up from r")
def escape_ways(spark, d):
    e = pairs(spark, d).select("doc_id", "line", G.escape_distances(F.col("a"), F.col("b"), 0.2).alias("e"))
    return e.select("doc_id", "line", *[rounded(F.col(f"e.{c}")).alias(n) for c, n in (("left", "left_"), ("right", "right_"), ("down", "down"), ("up", "up"))])


@query(f"with {BOXES} select doc_id, line, k, round(v, 6) as v from (select doc_id, line, unnest([0, 1, 2, 3, 4, 5]) as k, unnest([(x - 0) / 400, ((x - 0) / 400 + (x2 - 0) / 400) / 2, (x2 - 0) / 400, (y2 + 900) / 900, ((y2 + 900) / 900 + (y + 900) / 900) / 2, (y + 900) / 900]) as v from boxes)")
def page_coordinates(spark, d):
    unit = G.on_unit_page(F.col("box"), G.box(0, -900, 400, 0))
    return boxed(spark, d).select("doc_id", "line", F.posexplode(G.alignment_coordinates(unit)).alias("k", "v")).withColumn("v", rounded(F.col("v")))


@query(f"with {NEXT} select doc_id, line, bx - ax as dx, b_y - ay as dy, round(least((bx2 - bx) / (ax2 - ax), (by2 - b_y) / (ay2 - ay)), 6) as scale from pairs")
def box_moves(spark, d):
    m = pairs(spark, d).select("doc_id", "line", G.translation_and_scale(F.col("a"), F.col("b")).alias("m"))
    return m.select("doc_id", "line", "m.dx", "m.dy", rounded(F.col("m.scale")).alias("scale"))


@query(f"with {BOXES} select doc_id, min(x) as x, min(y) as y, max(x2) as x2, max(y2) as y2 from boxes group by doc_id")
def bounding_boxes(spark, d):
    return boxed(spark, d).groupBy("doc_id").agg(G.bounding_box(F.col("box")).alias("b")).select("doc_id", "b.*")


MATRICES = "m as (select l_orderkey, l_linenumber, 1 + l_quantity / 50 as a, l_discount as b, -l_tax as c, 1 + l_linenumber / 10.0 as d, l_quantity as e, l_linenumber::double as f from lineitem)"


def matrices(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.matrix(1 + q / 50, F.col("l_discount"), -F.col("l_tax"), 1 + n / 10.0, q, n).alias("m"))


@query(f"with {MATRICES} select l_orderkey, l_linenumber, round(a * 2 + b * 0.5, 6) as a, round(a * 0 + b * 3, 6) as b, round(c * 2 + d * 0.5, 6) as c, round(d * 3, 6) as d, round(e * 2 + f * 0.5 + 7, 6) as e, round(f * 3 + 8, 6) as f from m")
def multiplied_matrices(spark, d):
    m = matrices(spark, d).withColumn("p", G.multiply(F.col("m"), G.matrix(2, 0, 0.5, 3, 7, 8)))
    return m.select("l_orderkey", "l_linenumber", *[rounded(F.col(f"p.{c}")).alias(c) for c in "abcdef"])


@query(f"with {MATRICES} select l_orderkey, l_linenumber, round(a * 0.5, 6) as a, round(d * 0.5, 6) as d, round(e * 0.5 + 3, 6) as e, round(f * 0.5 + 4, 6) as f from m")
def moved_matrices(spark, d):
    m = matrices(spark, d).withColumn("p", G.moved(F.col("m"), F.lit(3.0), F.lit(4.0), F.lit(0.5)))
    return m.select("l_orderkey", "l_linenumber", *[rounded(F.col(f"p.{c}")).alias(c) for c in "adef"])


@query(f"with {MATRICES} select l_orderkey, l_linenumber, e as dx, f as dy, round(degrees(atan2(b, a)), 6) as rotation, round(sqrt(a * a + b * b), 6) as scale_x, round((a * d - b * c) / sqrt(a * a + b * b), 6) as scale_y, round((a * c + b * d) / (a * d - b * c), 6) as shear from m")
def decomposed_matrices(spark, d):
    m = matrices(spark, d).withColumn("p", G.decompose(F.col("m")))
    return m.select("l_orderkey", "l_linenumber", "p.dx", "p.dy", *[rounded(F.col(f"p.{c}")).alias(c) for c in ("rotation", "scale_x", "scale_y", "shear")])


@query("with s as (select l_orderkey, l_linenumber, case when l_linenumber % 3 > 0 then l_quantity / 50 end as a, case when l_linenumber % 4 > 0 then l_discount * 10 end as b, l_tax * 10 as c from lineitem) select l_orderkey, l_linenumber, round(least(greatest((coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0) - c * 0.3) / nullif(case when a is null then 0 else 0.6 end + case when b is null then 0 else 0.4 end, 0), 0), 1), 6) as score from s")
def combined_signals(spark, d):
    n = F.col("l_linenumber")
    a, b = F.when(n % 3 > 0, F.col("l_quantity") / 50), F.when(n % 4 > 0, F.col("l_discount") * 10)
    score = G.combined({"a": a, "b": b, "c": F.col("l_tax") * 10}, {"a": 0.6, "b": 0.4, "c": -0.3})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(score).alias("score"))


@query("with l as (select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as q from lineitem group by 1), t as (select l_orderkey, list_sum(q) as t, q from l) select l_orderkey, i::int as i, round(q[i + 1] / t, 6) as share from t, range(0, 50) r(i) where i < len(q) and t > 0")
def length_shares(spark, d):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("q")))), lambda x: x["q"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(q.alias("q")).select("l_orderkey", F.posexplode(G.shares(F.col("q"))).alias("i", "share")).withColumn("share", rounded(F.col("share")))


@query("select o_orderkey, round_even(o_orderkey / 8.0, 1)::double as even, round(-ln(1 - least(greatest(o_orderkey % 100 / 90.0, 0), 0.999999)), 6) as logged, least(greatest(o_orderkey % 10 / 8.0, 0.2), 0.9)::double as prior from orders")
def rounded_and_clipped(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", G.half_even(k / 8, 1).alias("even"), rounded(G.clipped_log(k % 100 / 90)).alias("logged"), G.soft_prior(k % 10 / 8, 0.2, 0.9).alias("prior"))


@query("select l_orderkey, l_linenumber, round(case when l_linenumber % 5 = 0 and l_linenumber % 2 = 0 then null when l_linenumber % 5 = 0 then l_tax when l_linenumber % 2 = 0 then l_discount else (l_discount + l_tax) / 2 end, 6) as mean, case when l_linenumber % 5 = 0 then null when greatest(l_discount, l_tax) = 0 then 0 else round(abs(l_discount - l_tax) / greatest(l_discount, l_tax), 6) end as delta from lineitem")
def means_and_deltas(spark, d):
    n = F.col("l_linenumber")
    a, b = F.when(n % 5 != 0, F.col("l_discount")), F.when(n % 2 != 0, F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(G.mean_of(a, b)).alias("mean"), rounded(A.relative_delta(a, F.col("l_tax"))).alias("delta"))


# Records.


@query("with t as (select p_brand, trim(p_name) as src, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then repeat('x', 60 + p_size) else p_type end as tgt from part) select p_brand, src, trim(tgt) as tgt from t where length(src) between 1 and 99 and length(trim(tgt)) between 1 and 99")
def reply_terms(spark, d):
    k = F.col("p_size") % 4
    tgt = F.when(k == 0, "").when(k == 1, F.expr("repeat('x', 60 + p_size)")).otherwise(F.col("p_type"))
    reply = F.to_json(F.collect_list(F.struct(F.concat(F.lit(" "), "p_name").alias("src"), tgt.alias("tgt"))))
    return table(spark, d, "part").groupBy("p_brand").agg(reply.alias("reply")).select("p_brand", F.explode(R.term_pairs(F.col("reply"))).alias("t")).select("p_brand", "t.src", "t.tgt")


@query("select event_id, case event_id % 5 when 0 then null else k end as k, case event_id % 5 when 0 then 'not_json' when 1 then 'missing:note' when 2 then 'extra_field' else case when k > 50 then 'bounds:k' when event_type not in ('click', 'purchase') then 'vocabulary:note' end end as violation from (select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events) where event_id % 5 = 0 or true")
def strict_replies(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    m, note = F.col("event_id") % 5, F.col("event_type")
    reply = F.when(m == 0, F.lit("no json")).when(m == 1, F.to_json(F.struct("k"))).when(m == 2, F.to_json(F.struct("k", note.alias("note"), F.lit(1).alias("more")))).otherwise(F.to_json(F.struct("k", note.alias("note"))))
    r = R.strict_reply(reply, {"k": "long", "note": "string"}, {"k": (0, 50)}, {"note": ["click", "purchase"]})
    return e.select("event_id", F.when(m != 0, F.col("k")).alias("k"), r["violation"].alias("violation"))


@query("select o_orderkey, '{\"a\":\"' || o_orderpriority || '\",\"b\":\"' || o_orderstatus || '\"}' as settings, sha256(o_orderpriority || chr(10) || o_orderstatus) as digest from orders")
def cache_digests(spark, d):
    m = F.create_map(F.lit("b"), "o_orderstatus", F.lit("a"), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", R.canonical_json(m).alias("settings"), R.cache_digest(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("digest"))


@query("select p_partkey, substring(sha256(p_name || chr(31) || p_partkey), 1, 7) as id, '{\"name\":\"' || p_name || '\"}' as kept, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' as record from part")
def record_ids(spark, d):
    m = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    return table(spark, d, "part").select("p_partkey", R.short_id(F.col("p_name"), F.col("p_partkey").cast("string"), length=7).alias("id"), F.to_json(R.without_fields(m, ["brand"])).alias("kept"), R.record("p_size", "p_name").alias("record"))


# Aggregates.


@query("with t as (select l_suppkey, l_shipdate::date as term, count(*) as n, bool_or(l_linenumber > 1) as mid, count(distinct l_orderkey) as paragraphs from lineitem group by all) select l_suppkey, term, n, paragraphs, rank from (select *, row_number() over (partition by l_suppkey order by n desc, term) as rank from t where n >= 2 and mid and paragraphs >= 2) where rank <= 10")
def frequent_terms(spark, d):
    u = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("term"), F.col("l_orderkey").alias("paragraph"), (F.col("l_linenumber") > 1).alias("mid_sentence"))
    return A.qualifying_terms(u, ["l_suppkey"], 2, 2, 10)


@query("with c as (select l_suppkey, l_discount, sum(l_quantity) as w from lineitem group by all), m as (select l_suppkey, l_discount as mode from c qualify row_number() over (partition by l_suppkey order by w desc, l_discount) = 1) select l_suppkey, least(l_discount, mode) as l_discount, count(*) as n from lineitem join m using (l_suppkey) group by l_suppkey, least(l_discount, mode)")
def clamped_scales(spark, d):
    return A.clamped_to_mode(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity").groupBy("l_suppkey", "l_discount").agg(F.count("*").alias("n"))


@query("select l_orderkey, case when max(l_quantity) - min(l_quantity) <= 5 then 1 end as near, case when count(distinct l_returnflag) = 1 then max(l_returnflag) end as flag from lineitem group by l_orderkey")
def agreed_values(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(A.agreed("l_quantity", 5.0).isNotNull(), 1).alias("near"), A.agreed("l_returnflag").alias("flag"))


@query("with g as (select o_custkey, abs(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey)) as g from orders), p as (select o_custkey, list_sort(list(g) filter (where g > 0)) as v from g group by 1) select o_custkey, coalesce(v[len(v) // 2 + 1], 10.0) as spacing from p")
def line_spacings(spark, d):
    return A.line_spacing(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("select o_orderpriority, case when count_if(o_orderstatus <> 'P') - count_if(o_custkey % 10 = 0) > 0 then round(count_if(o_orderstatus = 'O') / (count_if(o_orderstatus <> 'P') - count_if(o_custkey % 10 = 0)), 6) end as rate from orders group by 1")
def strict_rates(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(A.strict_rate(s == "O", s != "P", F.col("o_custkey") % 10 == 0), 6).alias("rate"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then null else coalesce(case when o_orderkey % 3 > 0 then o_orderstatus = 'F' end, true) and coalesce(case when o_orderkey % 2 > 0 then o_totalprice > 100000 end, true) end as kept from orders")
def conserved_levels(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", A.all_levels(F.when(k % 3 > 0, F.col("o_orderstatus") == "F"), F.when(k % 2 > 0, F.col("o_totalprice") > 100000)).alias("kept"))


@query("select l_suppkey, l_returnflag, round(sum(l_discount) / nullif(sum(l_tax), 0), 6) as ratio from lineitem group by all")
def summed_ratios(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(A.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"))


@query("select o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] as middle from orders group by 1")
def upper_medians(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(A.upper_median("o_totalprice").alias("middle"))


# Joins.


@query(f"with {BOXES}, {REGIONS}, m as (select a.doc_id, a.line, b.layout_id as formula_idx, {PAIR} / {AREA.format('a')} as share, a.x >= b.x - 2 and a.x2 <= b.x2 + 2 and a.y >= b.y - 2 and a.y2 <= b.y2 + 2 as inside, sqrt(pow((a.x + a.x2 - b.x - b.x2) / 2, 2) + pow((a.y + a.y2 - b.y - b.y2) / 2, 2)) as away from boxes a join regions b using (doc_id) where layout_id % 3 > 0 or layout_id % 3 = a.line % 3), t as (select *, case when share >= 0.95 then 'exact' when inside then 'contained' end as match_type from m), s as (select *, case when match_type = 'exact' then share else 0.5 + 0.4 * greatest(0, 1 - away / 100) end as score from t where match_type is not null) select doc_id, line, formula_idx, match_type, round(score, 6) as score from s qualify row_number() over (partition by doc_id, line order by match_type <> 'exact', score desc, formula_idx) = 1")
def formula_elements(spark, d):
    k = F.col("layout_id") % 3
    f = regions(spark, d).select("doc_id", F.col("layout_id").alias("formula_idx"), "box", F.when(k == 0, k).alias("xobj_id"))
    e = boxed(spark, d).withColumn("xobj_id", F.col("line") % 3)
    return J.assigned_elements(e, f, ["doc_id"], ["line"]).withColumn("score", F.round("score", 6))


@query(f"with {BOXES}, {REGIONS}, m as (select a.doc_id, a.line, b.layout_id as o from boxes a join regions b using (doc_id) where a.line <> b.layout_id and {PAIR} / ({AREA.format('a')} + {AREA.format('b')} - {PAIR}) >= 0.2) select l.doc_id, l.line, coalesce(array_to_string(list_sort(list(distinct o) filter (where o is not null)), ','), '') as on_ from boxes l left join m using (doc_id, line) group by all")
def stood_on(spark, d):
    others = regions(spark, d).select("doc_id", F.col("layout_id").alias("line"), "box")
    on = J.standing_on(boxed(spark, d).select("doc_id", "line", "box"), others, ["doc_id"], "line", 0.2)
    return on.select("doc_id", "line", F.array_join(J.induced(F.array().cast("array<int>"), F.col("on").cast("array<int>")).cast("array<string>"), ",").alias("on_"))


@query(f"with {BOXES}, m as (select a.doc_id, a.line, min(case when b.x >= a.x2 and least(a.y2, b.y2) > greatest(a.y, b.y) then b.x end) as r, max(case when b.y2 <= a.y and least(a.x2, b.x2) > greatest(a.x, b.x) then b.y2 end) as t from boxes a left join (select doc_id, line, x + case when line % 2 = 0 then 150 else 0 end as x, x2 + case when line % 2 = 0 then 150 else 0 end as x2, y, y2 from boxes) b using (doc_id) group by all) select doc_id, line, least(540.0, r) as right_limit, greatest(-4400.0, t) as bottom_limit from m")
def free_space(spark, d):
    b = F.col("box")
    p = boxed(spark, d).select("doc_id", "line", "box", G.box(0, -4000, 600, 0).alias("crop"))
    move = F.when(F.col("line") % 2 == 0, 150.0).otherwise(0.0)
    blockers = boxed(spark, d).select("doc_id", F.col("line").alias("idx"), G.box(b["x"] + move, b["y"], b["x2"] + move, b["y2"]).alias("box"))
    return J.nearest_free(p, blockers, ["doc_id"], "line")


CHARS = "chars as (select l_orderkey, l_linenumber as char_idx, min(l_partkey % 400)::double as x, min(l_partkey % 400)::double + 4 as x2, min(l_quantity) as size from lineitem group by all)"


def line_chars(spark: SparkSession, d: str) -> DataFrame:
    """A character for each order and line number."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("char_idx")).agg(F.min(F.col("l_partkey") % 400).cast("double").alias("x"), F.min("l_quantity").alias("size"))
    return c.withColumn("box", G.box(F.col("x"), 0, F.col("x") + 4, 10))


@query(f"with {CHARS}, f as (select * from chars where char_idx % 2 = 0), c as (select * from chars where char_idx % 2 = 1) select f.l_orderkey, f.char_idx as idx, arg_max(c.char_idx, (c.x2, -c.char_idx)) filter (where c.x2 <= f.x) as left_char, min(f.x - c.x2) filter (where c.x2 <= f.x) as left_gap, arg_min(c.char_idx, (c.x, c.char_idx)) filter (where c.x >= f.x2) as right_char, min(c.x - f.x2) filter (where c.x >= f.x2) as right_gap from f left join c using (l_orderkey) group by all")
def formula_neighbours(spark, d):
    c = line_chars(spark, d)
    f = c.where("char_idx % 2 = 0").select("l_orderkey", F.col("char_idx").alias("idx"), "box")
    return J.nearest_sides(f, c.where("char_idx % 2 = 1").select("l_orderkey", "char_idx", "box"), ["l_orderkey"], "idx")


@query("with can as (select p_type as unicode, p_size % 2 = 0 as bold, p_size % 3 = 0 as italic, p_brand as font, min(p_partkey) as priority from part group by all), best as (select unicode, bold, italic, arg_min(font, priority) as mapped_font from can group by all) select p_partkey, mapped_font from (select p_partkey, p_type as unicode, p_partkey % 2 = 0 as bold, p_partkey % 3 = 0 as italic from part) left join best using (unicode, bold, italic)")
def mapped_fonts(spark, d):
    p = table(spark, d, "part")
    can = p.groupBy(F.col("p_type").alias("unicode"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"), F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("priority"))
    can = can.withColumn("font_id", F.concat_ws("|", "brand", "unicode", F.col("bold").cast("string"), F.col("italic").cast("string")))
    k = F.col("p_partkey")
    chars = p.select("p_partkey", F.col("p_type").alias("unicode"), (k % 2 == 0).alias("bold"), (k % 3 == 0).alias("italic"))
    m = J.first_font(chars, can.select("font_id", "bold", "italic", "priority"), can.select("font_id", "unicode"))
    return m.select("p_partkey", F.split_part("mapped_font", F.lit("|"), F.lit(1)).alias("mapped_font"))


@query("with f as (select case when s_nationkey % 4 = 0 then 0 else s_nationkey end as scope, s_suppkey % 10 as font_id, min(s_name) as font from supplier group by all) select c_custkey, coalesce(o.font, p.font) as font from customer c left join f o on o.scope = c.c_nationkey and o.font_id = c.c_custkey % 10 left join (select * from f where scope = 0) p on p.font_id = c.c_custkey % 10")
def scoped_fonts(spark, d):
    n = F.col("s_nationkey")
    f = table(spark, d, "supplier").groupBy(F.when(n % 4 == 0, 0).otherwise(n).alias("scope"), (F.col("s_suppkey") % 10).alias("font_id")).agg(F.min("s_name").alias("font"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 10).alias("font_id"))
    return J.scoped(c, f).select("c_custkey", "font")


@query("select p_partkey, p_type as was, coalesce(case when p_partkey % 4 = 0 then p_brand end, p_type) as kind from part")
def ruled_terms(spark, d):
    p = table(spark, d, "part")
    return J.overlaid(p.select("p_partkey", F.col("p_type").alias("kind")), p.where("p_partkey % 4 = 0").select("p_partkey", F.col("p_brand").alias("kind")), ["p_partkey"], "kind")


@query("with pages as (select o_orderkey as page, o_custkey as article_id from orders) select a.page as first, b.page as second, a.article_id from pages a join pages b on b.page = a.page + 1 and b.article_id // 10 = a.article_id // 10")
def article_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.floor(F.col("o_custkey") / 10).alias("article_id"), "o_custkey")
    p = J.same_article(o.select(F.col("page").alias("first"), (F.col("page") + 1).alias("second")), o.select("page", "article_id"))
    return p.join(o.select(F.col("page").alias("first"), "o_custkey"), "first").select("first", "second", F.col("o_custkey").alias("article_id"))


@query("with v as (select p_partkey as page, p_type as kind from part), l as (select p_partkey as page, case when p_size % 2 = 0 then [p_type] else ['ECONOMY', 'STANDARD'] end as accepted from part where p_partkey % 3 > 0), pol as (select distinct p_type as kind, length(p_type) as policy from part) select page, list_contains(accepted, kind) as hit, coalesce((select bool_or(q.policy = w.policy) from pol q, pol w where w.kind = v.kind and list_contains(l.accepted, q.kind)), false) as policy_hit from v join l using (page)")
def label_scores(spark, d):
    p = table(spark, d, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("page"), "p_type", "p_size")
    labels = p.where("page % 3 > 0").select("file", "page", F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array(F.lit("ECONOMY"), F.lit("STANDARD"))).alias("accepted"))
    policies = p.select(F.col("p_type").alias("kind"), F.length("p_type").alias("policy")).distinct()
    return J.scored_labels(p.select("file", "page", F.col("p_type").alias("kind")), labels, policies).select("page", "hit", "policy_hit")


@query("with t as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]{10,}'))) as source from benchmark) select t.source, min(doc_id) as first_page from t left join documents d on contains(regexp_replace(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+', ' ', 'g'), t.source) group by t.source")
def term_first_pages(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{10,})"))).alias("s")).select(F.lower("s").alias("source")).distinct()
    return passes.first_pages(terms, table(spark, d, "documents").select(F.col("doc_id").alias("page_number"), "text"))


@query("with t as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]{9,}'))) as source from benchmark), m as (select source, conv_id * 1000 + turn as id from t, conversations where contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), source)) select source, count(id) as matches, coalesce(array_to_string(list_sort(list(id) filter (where id is not null))[1:3], ','), '') as samples from t left join m using (source) group by source")
def term_match_counts(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"))).alias("s")).select(F.lower("s").alias("source")).distinct()
    asked = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    m = passes.match_counts(terms, asked)
    return m.select("source", "matches", F.coalesce(F.array_join(F.transform("samples", lambda s: s["id"].cast("string")), ","), F.lit("")).alias("samples"))


# Windows.


@query(f"with {BOXES}, m as (select *, lag(y) over w as py, lag(y2) over w as py2 from (select doc_id, line, n, y - n % 13 as y, y2 - n % 13 as y2 from boxes) window w as (partition by doc_id order by line)) select doc_id, line, sum(case when greatest(least(y2, py2) - greatest(y, py), 0) / (y2 - y) < 0.1 then 1 else 0 end) over (partition by doc_id order by line)::bigint as row_ from m")
def character_lines(spark, d):
    b, n = F.col("box"), F.col("n")
    c = boxed(spark, d).withColumn("row_key", F.col("line")).select("doc_id", "row_key", G.box(b["x"], b["y"] - n % 13, b["x2"], b["y2"] - n % 13).alias("box"))
    return W.lines_of(c, ["doc_id"], ["row_key"], 0.1).select("doc_id", F.col("row_key").alias("line"), F.col("line").alias("row_"))


@query("select conv_id, turn, sum(cut) over (partition by conv_id order by turn)::bigint as run from (select conv_id, turn, case when role is distinct from lag(role) over (partition by conv_id order by turn) then 1 else 0 end as cut from conversations where turn % 3 <> 1)")
def role_runs(spark, d):
    return W.runs(table(spark, d, "conversations").where("turn % 3 != 1"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", F.col("island").alias("run"))


@query("with u as (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 as col, l_quantity as y2, l_partkey % 100 as x from lineitem) select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by col, y2 desc, x, l_linenumber, l_partkey) as reading from u qualify count(*) over (partition by l_orderkey, col, y2, x) = 1")
def reading_order_ranks(spark, d):
    x = F.col("l_partkey") % 100
    u = table(spark, d, "lineitem").withColumns({"column": F.col("l_suppkey") % 3, "box": G.box(x, 0, x, F.col("l_quantity"))})
    alone = F.count("*").over(W.Window.partitionBy("l_orderkey", "column", "l_quantity", x))
    return W.reading_ranks(u, ["l_orderkey"]).withColumn("_a", alone).where("_a = 1").select("l_orderkey", "l_linenumber", "l_partkey", "reading")


@query("with c as (select l_orderkey, l_linenumber as k, min(l_partkey % 400)::double as x, min(l_quantity) as y from lineitem group by all), s as (select *, lead(x) over w - x as dx, lead(y) over w - y as dy from c window w as (partition by l_orderkey order by k)) select l_orderkey, sum(dx) as dx, sum(dy) as dy, sum(abs(dx)) as across, sum(abs(dy)) as down, coalesce(sum(abs(dy)) > sum(abs(dx)), false) as vertical from s group by 1")
def reading_travel(spark, d):
    c = line_chars(spark, d).withColumn("box", G.box(F.col("x"), F.col("size"), F.col("x"), F.col("size")))
    return W.travel(c, ["l_orderkey"], ["char_idx"])


@query("with c as (select l_orderkey, l_linenumber as k, min(l_quantity) as s, min(l_partkey) % 4 = 0 as blocked from lineitem group by all), r as (select *, sum(case when blocked then 1 else 0 end) over (partition by l_orderkey order by k) as g from c) select l_orderkey, k, sum(case when blocked then 0 else s end) over (partition by l_orderkey, g order by k) as total_shift from r")
def column_shifts(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").alias("shift"), (F.min("l_partkey") % 4 == 0).alias("blocked"))
    return W.shifted_columns(c, ["l_orderkey"], ["k"]).select("l_orderkey", "k", "total_shift")


@query("with c as (select l_orderkey, l_linenumber as k, min(l_quantity) as y_new, max(l_quantity) + any_value(l_linenumber) as y_old from lineitem group by l_orderkey, l_linenumber), a as (select *, lag(y_new) over (partition by l_orderkey order by k) as above from c) select l_orderkey, k, case when abs(y_new - y_old) > 6 then 'cap' when y_new < 5 then 'frame' when y_new > above then 'monotone' when above - y_new < 10 then 'gap' end as violation from a")
def guard_violations(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").alias("y_new"), F.max("l_quantity").alias("m"))
    c = c.select("l_orderkey", "k", "y_new", (F.col("m") + F.col("k")).alias("y_old"), F.lit(5.0).alias("y_floor"), F.lit(10.0).alias("height"))
    return W.first_violation(c, ["l_orderkey"], ["k"], 6.0).select("l_orderkey", "k", "violation")


@query("with p as (select o_custkey, o_orderkey, case when o_orderkey % 4 = 1 then '12' else 'text' end as t, o_orderkey % 3 as lay from orders), r as (select *, regexp_matches(t, '^[0-9\\s]*$') as num, last_value(case when t = 'text' then lay end ignore nulls) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as before_lay, lag(t = '12') over (partition by o_custkey order by o_orderkey) as after_num from p) select o_custkey, o_orderkey, sum(case when not num and not (coalesce(after_num, false) and before_lay is not distinct from lay) then 1 else 0 end) over (partition by o_custkey order by o_orderkey)::bigint as merged from r")
def numbered_paragraphs(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 4 == 1, "12").otherwise("text").alias("text"), (k % 3).alias("layout_id"), F.lit(None).cast("int").alias("xobj_id"))
    return W.line_numbers_merged(p, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "merged")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def top_excerpts(spark, d):
    return W.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


# Folds.


@query("with recursive n as (select o_custkey, o_orderkey, o_totalprice as v, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as k from orders), b as (select o_custkey, o_orderkey, k, v as first, 0::bigint as band from n where k = 1 union all select n.o_custkey, n.o_orderkey, n.k, case when n.v - b.first > 30000 then n.v else b.first end, case when n.v - b.first > 30000 then b.band + 1 else b.band end from b join n on n.o_custkey = b.o_custkey and n.k = b.k + 1) select o_custkey, o_orderkey, band from b")
def column_bands(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return folds.seeded_bands(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", 30000.0).select("o_custkey", "o_orderkey", "band")


@query(f"with recursive {CHARS}, n as (select l_orderkey, char_idx, char_idx % 2 as font, size, row_number() over (partition by l_orderkey order by char_idx) as k from chars), b as (select l_orderkey, char_idx, k, font, size, 0::bigint as run from n where k = 1 union all select n.l_orderkey, n.char_idx, n.k, case when n.font <> b.font or abs(n.size - b.size) > 20 then n.font else b.font end, case when n.font <> b.font or abs(n.size - b.size) > 20 then n.size else b.size end, case when n.font <> b.font or abs(n.size - b.size) > 20 then b.run + 1 else b.run end from b join n on n.l_orderkey = b.l_orderkey and n.k = b.k + 1) select l_orderkey, char_idx, run from b")
def style_run_numbers(spark, d):
    c = line_chars(spark, d).select("l_orderkey", "char_idx", (F.col("char_idx") % 2).cast("string").alias("font_id"), F.col("size").alias("font_size"))
    return folds.style_runs(c, ["l_orderkey"], ["char_idx"], tolerance=20.0).select("l_orderkey", "char_idx", "run")


@query("with recursive n as (select conv_id, turn, trim(substring(text, 1, 12)) || case when turn % 3 = 0 then '-' else '' end as m, row_number() over (partition by conv_id order by turn) as k from conversations where trim(substring(text, 1, 12)) <> ''), j as (select conv_id, k, m as s from n where k = 1 union all select n.conv_id, n.k, case when regexp_matches(j.s, '\\p{L}-$') and regexp_matches(n.m, '^\\p{Ll}') then regexp_replace(j.s, '-$', '') || n.m else rtrim(j.s) || ' ' || n.m end from j join n on n.conv_id = j.conv_id and n.k = j.k + 1) select conv_id, s as text from j qualify row_number() over (partition by conv_id order by k desc) = 1")
def joined_chain_texts(spark, d):
    m = F.concat(F.trim(F.substring("text", 1, 12)), F.when(F.col("turn") % 3 == 0, "-").otherwise(""))
    t = table(spark, d, "conversations").where(F.trim(F.substring("text", 1, 12)) != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))).alias("c"))
    return t.select("conv_id", folds.joined_members(F.transform("c", lambda x: x["m"])).alias("text"))


@query("with u as (select o_custkey, sum(o_totalprice / 1000) as w from orders group by 1), s as (select o_custkey, w, unnest([1, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]::double[]) as scale from u), f as (select o_custkey, any_value(w) as w, coalesce(max(scale) filter (where ceil(w * scale / 200) * 12 * scale <= 60), 0.1) as scale from s group by 1) select o_custkey, scale, ceil(w * scale / 200)::bigint as lines from f")
def typeset_scales(spark, d):
    u = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("width"), F.lit(200.0).alias("m"), F.lit(60.0).alias("r"), F.lit(12.0).alias("h"))
    return folds.optimal_scale(u, ["o_custkey"], "m", "r", "h")


@query("with recursive n as (select o_custkey, o_orderkey as idx, o_totalprice / 1000 as y2, row_number() over (partition by o_custkey order by o_orderkey) as k from orders), s as (select a.o_custkey, a.k, a.idx as first, b.idx as second, b.y2 - a.y2 > 20 as jump from n a join n b on b.o_custkey = a.o_custkey and b.k = a.k + 1), w as (select o_custkey, k, first, second, jump as taken from s where k = 1 union all select s.o_custkey, s.k, s.first, s.second, s.jump and not w.taken from w join s on s.o_custkey = w.o_custkey and s.k = w.k + 1) select o_custkey, first, second from w where taken")
def cross_column_pairs(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 1000).alias("y2"))
    return folds.greedy_pairs(o, ["o_custkey"], ["idx"], 20.0)


@query("with c as (select l_orderkey, l_linenumber as i, min(l_partkey) % 3 as font, min(l_discount) as descent from lineitem group by all), v as (select l_orderkey, font, arg_min(descent, (-n, f)) as m from (select l_orderkey, font, descent, count(*) as n, min(i) as f from c group by all) group by all) select l_orderkey, i as char_idx, round(10 - m, 6) as y from c join v using (l_orderkey, font)")
def raised_characters(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("char_idx")).agg((F.min("l_partkey") % 3).alias("font_id"), F.min("l_discount").alias("descent")).withColumn("box", G.box(0, 10, 5, 20))
    return A.without_descent(c, ["l_orderkey"]).select("l_orderkey", "char_idx", F.round("box.y", 6).alias("y"))


@query("select l_orderkey, count(distinct coalesce(case when l_suppkey % 2 = 0 then l_suppkey % 3 end, -1)) = 1 as same from lineitem group by 1")
def single_layouts(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 3).alias("layout_id"))
    return J.one_layout(c, ["l_orderkey"])


# Passes.


@query("select conv_id, turn from conversations where conv_id % 5 > 0 and length(text) >= 60 and not (turn % 4 = 3) and role = 'user' and not exists (select 1 from conversations t where t.conv_id = conversations.conv_id and t.turn = conversations.turn and length(t.text) % 7 = 0)")
def sendable_paragraphs(spark, d):
    t = table(spark, d, "conversations")
    p = t.select("conv_id", "turn", "text", F.when(F.col("conv_id") % 5 > 0, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("debug_id"), (F.col("turn") % 4 == 3).alias("vertical"), F.when(F.col("role") == "user", "text").otherwise("title").alias("layout_label"))
    taken = p.where("length(text) % 7 = 0 and debug_id is not null")
    return passes.sendable(p, taken, 60, True).select("conv_id", "turn")


@query("with u as (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 2 as r, (l_partkey % 50) * 10.0 as x from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1) select l_orderkey, l_linenumber from u a where not exists (select 1 from u b where b.l_orderkey = a.l_orderkey and b.l_linenumber <> a.l_linenumber and b.r = a.r and greatest(a.x - (b.x + 5), b.x - (a.x + 5)) <= 60)")
def solitary_units(spark, d):
    x = (F.col("l_partkey") % 50) * 10.0
    y = F.col("l_suppkey") % 2 * 100
    u = table(spark, d, "lineitem").withColumn("_n", F.count("*").over(W.Window.partitionBy("l_orderkey", "l_linenumber"))).where("_n = 1")
    u = u.select("l_orderkey", "l_linenumber", G.box(x, y, x + 5, y + 10).alias("box"), F.lit(60.0).alias("font_size"))
    return passes.solitary(u, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("with u as (select o_custkey, o_orderkey % 4 as page, o_orderkey % 2 as col, o_orderkey as k from orders), e as (select o_custkey, page, col, min(k) as head, max(k) as tail from u group by all), b as (select *, lead(page) over w as p1, lead(col) over w as c1, lead(head) over w as h1, lead(page, 2) over w as p2, lead(col, 2) over w as c2, lead(head, 2) over w as h2 from e window w as (partition by o_custkey order by page, col)) select o_custkey, page, col, tail, 1 as skip, p1 as head_page, c1 as head_column, h1 as head from b where h1 is not null union all select o_custkey, page, col, tail, 2, p2, c2, h2 from b where h2 is not null")
def column_pairs(spark, d):
    k = F.col("o_orderkey")
    u = table(spark, d, "orders").select("o_custkey", (k % 4).alias("page"), (k % 2).alias("column"), k.alias("par_idx"), k.alias("reading"))
    return passes.page_column_pairs(u, ["o_custkey"]).withColumnRenamed("column", "col")


@query("with l as (select distinct p_brand as chain_id, p_type as label from part where p_partkey % 7 = 0), c as (select distinct p_type as label, length(p_type) % 2 as class from part), n as (select chain_id, count(*) as n from l group by 1), h as (select chain_id, class, count(*) as h from l join c using (label) group by all) select n.chain_id, min(class) as class from n left join h on h.chain_id = n.chain_id and h.h = n.n group by 1")
def chain_classes(spark, d):
    p = table(spark, d, "part")
    return passes.class_of_labels(p.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("chain_id"), F.col("p_type").alias("label")), p.select((F.length("p_type") % 2).alias("class"), F.col("p_type").alias("label")))


@query("with p as (select l_orderkey, l_linenumber % 2 as k, max(l_discount * 10) as a, min(l_tax * 10) as b, bool_or(l_quantity > 10) as eligible from lineitem group by all), s as (select l_orderkey, k, eligible, case when eligible then least(greatest((a * case when k = 0 then 0.7 else 0.2 end + b * case when k = 0 then 0.3 else 0.8 end) / 1.0, 0), 1) end as score from p), t as (select * from s qualify row_number() over (partition by l_orderkey order by coalesce(score, -1) desc, k) = 1) select l_orderkey, case when k = 0 then 'body' else 'title' end as pair, round(score, 6) as score, coalesce(score >= 0.5, false) as linked, case when coalesce(score >= 0.5, false) then null when score is null then 'not_eligible' else 'below_threshold' end as reason from t where score is null or abs(score - 0.5) > 1e-9")
def best_boundaries(spark, d):
    k = F.col("l_linenumber") % 2
    p = table(spark, d, "lineitem").groupBy("l_orderkey", k.alias("k")).agg(F.max(F.col("l_discount") * 10).alias("a"), F.min(F.col("l_tax") * 10).alias("b"), F.bool_or(F.col("l_quantity") > 10).alias("eligible"))
    p = p.withColumns({"pair": F.when(F.col("k") == 0, "body").otherwise("title"), "reason": F.when(~F.col("eligible"), "not_eligible")})
    b = passes.best_boundary(p, ["l_orderkey"], {"body": {"a": 0.7, "b": 0.3}, "title": {"a": 0.2, "b": 0.8}}, 0.5)
    return b.where("score is null or abs(score - 0.5) > 1e-9").withColumn("score", F.round("score", 6))


@query("select o_orderkey as boundary, case when o_orderkey % 3 = 0 then null when o_orderstatus = 'F' then 'linked' when o_orderpriority in ('1-URGENT', '2-HIGH') then 'trap' else 'clean' end as adjudication from orders")
def adjudications(spark, d):
    o = table(spark, d, "orders")
    truth = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("boundary"), (F.col("o_orderstatus") == "F").alias("linked"), F.col("o_orderpriority").alias("note"))
    return passes.adjudicated(o.select(F.col("o_orderkey").alias("boundary")), truth, ["urgent", "HIGH"])


@query("with r as (select l_orderkey, l_linenumber as i, any_value(case l_linenumber % 3 when 0 then 'formula' when 1 then 'plain' else 'styled' end) as kind, min(l_shipdate::date::varchar) as t from lineitem group by all), m as (select *, count_if(kind <> 'plain') over (partition by l_orderkey) as marks, bool_or(kind = 'plain' or kind = 'styled') over (partition by l_orderkey) as told from r), n as (select *, kind = 'formula' or (kind = 'styled' and marks <= 2) as mark from m), o as (select *, sum(mark::int) over (partition by l_orderkey order by i) as no from n) select l_orderkey, string_agg(case when told and mark and kind = 'formula' then '{v' || no || '}' when told and mark then '<s' || no || '>' || t || '</s' || no || '>' else t end, '' order by i) as sent from o group by 1")
def placeholder_texts(spark, d):
    n = F.col("l_linenumber")
    r = table(spark, d, "lineitem").groupBy("l_orderkey", n.alias("i")).agg(F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("text"))
    k = F.col("i") % 3
    return passes.with_placeholders(r.withColumn("kind", F.when(k == 0, "formula").when(k == 1, "plain").otherwise("styled")), ["l_orderkey"], "i", 2).select("l_orderkey", "sent")


@query("select conv_id, turn, unnest(['text', 'formula', 'text', 'styled']) as kind, unnest([null, 1, null, 2]::int[]) as number, unnest([role || ' ', null, ' and ', substring(text, 1, 5)]) as said from conversations where not contains(substring(text, 1, 5), '<') union all select conv_id, turn, 'text', null, ' end' from conversations where not contains(substring(text, 1, 5), '<')")
def parsed_replies(spark, d):
    t = table(spark, d, "conversations").where(~F.contains(F.substring("text", 1, 5), F.lit("<")))
    reply = F.concat("role", F.lit(" {V1} and <s2>"), F.substring("text", 1, 5), F.lit("</s2> end{v9}"))
    parts = passes.parsed_reply(F.lit("{v1} <s2>x</s2>"), reply)
    return t.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", "p.kind", "p.number", F.col("p.text").alias("said"))


@query("with p as (select o_custkey as article_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank, o_orderkey % 11 = 0 as opens from orders where o_orderpriority in ('1-URGENT', '5-LOW')) select o_orderkey, rank, round((o_orderkey % 30 + 10) / 20.0, 6) as ratio from p where (rank <= 2 or opens) and (o_orderkey % 30 + 10) / 20.0 >= 1.5")
def drop_cap_candidates(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    p = o.select(F.lit(1).alias("doc"), F.col("o_custkey").alias("article_id"), F.col("o_orderdate").alias("page_number"), k.alias("par_idx"), k.alias("debug_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "text").when(F.col("o_orderpriority") == "5-LOW", "plain text").otherwise("title").alias("layout_label"), (k % 11 == 0).alias("opens"))
    runs = o.select(F.lit(1).alias("doc"), k.alias("debug_id"), F.lit("A").alias("initial"), (k % 30 + 10).cast("double").alias("initial_size"), F.lit(20.0).alias("median_size"))
    return passes.drop_caps(p, runs, ["doc"], rank=2).select(F.col("debug_id").alias("o_orderkey"), "rank", F.round("ratio", 6).alias("ratio"))


@query(f"with {BOXES}, s as (select *, least(1.0, 400 / nullif(x2 - x, 0), 880 / nullif(y2 - y, 0)) as scale from boxes), f as (select *, case when x < 20 then 20 - x when x + (x2 - x) * scale > 420 then 420 - (x + (x2 - x) * scale) else 0 end as dx, case when y < -900 then -900 - y when y + (y2 - y) * scale > -20 then -20 - (y + (y2 - y) * scale) else 0 end as dy from s) select doc_id, line, case when scale < 0.6 then null when scale < 1 then 'shrink' when dx <> 0 or dy <> 0 then 'slide' else 'none' end as action, case when scale < 0.6 then 'scale_floor' end as refusal from f")
def containment_plans(spark, d):
    i = boxed(spark, d).select("doc_id", "line", "box").withColumn("bounds", G.box(20, -900, 420, -20))
    return passes.contained_plans(i).select("doc_id", "line", "action", "refusal")


@query(f"with {BOXES}, p as (select a.doc_id, a.line, a.x as ax, a.y as ay, a.x2 as ax2, a.y2 as ay2, b.x as bx, b.y as b_y, b.x2 as bx2, b.y2 as by2 from boxes a join boxes b on b.doc_id = a.doc_id and b.line = a.line + 1), q as (select *, (ax2 - ax) * (ay2 - ay) <= (bx2 - bx) * (by2 - b_y) as a_moves from p), m as (select doc_id, line, a_moves, case when a_moves then ax else bx end as x, case when a_moves then ay else b_y end as y, case when a_moves then ax2 else bx2 end as x2, case when a_moves then ay2 else by2 end as y2, case when a_moves then bx else ax end as ox, case when a_moves then b_y else ay end as oy, case when a_moves then bx2 else ax2 end as ox2, case when a_moves then by2 else ay2 end as oy2 from q) select doc_id, line, case when a_moves then 'a' else 'b' end as moves, (x2 - x) * (y2 - y) / ((ox2 - ox) * (oy2 - oy)) > 0.8 as alike from m")
def separation_movers(spark, d):
    a, b = boxed(spark, d).select("doc_id", "line", F.col("box").alias("box_a")), boxed(spark, d).select("doc_id", (F.col("line") - 1).alias("line"), F.col("box").alias("box_b"))
    p = passes.separation_plans(a.join(b, ["doc_id", "line"]).withColumn("page_box", G.box(-1e9, -1e9, 1e9, 1e9)))
    return p.select("doc_id", "line", "moves", F.coalesce(F.col("refusal") == "alike", F.lit(False)).alias("alike"))


@query("select event_id, case when event_type not in ('click', 'error') then 'unknown_kind' when not ((event_type = 'click' and event_id % 3 in (0, 1)) or (event_type = 'error' and event_id % 3 = 1)) then 'action' when event_id % 2 = 0 then 'not_one_paragraph' end as refusal from events")
def admitted_issues(spark, d):
    k = F.col("event_id")
    i = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.when(k % 3 == 0, "slide").when(k % 3 == 1, "shrink").otherwise("split").alias("action"), F.when(k % 2 == 0, F.array()).otherwise(F.array(F.lit("p"))).alias("paragraph_refs"))
    return passes.admitted(i, {"click": ["slide", "shrink"], "error": ["shrink"]}).select("event_id", "refusal")


@query("select o_custkey, count_if(o_orderkey % 4 > 0 and o_orderstatus <> 'O') >= greatest(0.4 * count(*), 1) as scanned from orders group by 1")
def scanned_documents(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus") != "O").alias("is_scanned"))
    return passes.scanned(o, ["o_custkey"], 0.4)


@query("select 'big' as field, count_if(o_totalprice > 100000)::bigint as rows from orders union all select 'late', count_if(o_orderstatus = 'P')::bigint from orders having count_if(o_orderstatus = 'P') > 0")
def unset_fields(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_totalprice") > 100000, 1).alias("big"), F.when(F.col("o_orderstatus") == "P", 1).alias("late"), F.when(F.col("o_totalprice") < -1, 1).alias("none"))
    return passes.fields_set(o, ["big", "late", "none"])


@query("with u as (select l_orderkey, 100 as o, l_linenumber as s, 'char ' || l_linenumber as op from lineitem union all select l_orderkey, case when l_linenumber = 1 then 5 else 20 end, l_linenumber, 'curve ' || l_linenumber from lineitem where l_linenumber % 2 = 1) select l_orderkey, string_agg(op, chr(10) order by o, s, op) as stream from u group by 1")
def drawn_streams(spark, d):
    n = F.col("l_linenumber")
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("page_number"), n.alias("sub_order"))
    chars = t.withColumn("op", F.concat(F.lit("char "), F.col("sub_order").cast("string")))
    curves = t.where("sub_order % 2 = 1").withColumn("op", F.concat(F.lit("curve "), F.col("sub_order").cast("string"))).withColumn("render_order", F.when(F.col("sub_order") == 1, 5))
    return passes.streams_of(passes.render_units(chars=chars, curves=curves), ["l_orderkey"])


@query(f"with {BOXES}, u as (select doc_id, line + 1000 as layout_id, case when line % 2 = 0 then 'paragraph_hybrid' else 'table_hybrid' end as class_name, x, y, x2, y2 from boxes union all select doc_id, line + 2000, case when line % 3 = 0 then 'title' else 'text' end, x, y - 0.1, x2, y2 from boxes), h as (select t.doc_id, t.layout_id, least(t.x, min(h.x)) as x, least(t.y, min(h.y)) as y, greatest(t.x2, max(h.x2)) as x2, greatest(t.y2, max(h.y2)) as y2 from u t join u h on h.doc_id = t.doc_id and h.class_name = 'paragraph_hybrid' and h.layout_id = t.layout_id - 1000 where t.class_name = 'text' group by t.doc_id, t.layout_id, t.x, t.y, t.x2, t.y2) select doc_id, layout_id, u.class_name, round(coalesce(h.y, u.y), 6) as y from u left join h using (doc_id, layout_id)")
def united_layouts(spark, d):
    b, k = F.col("box"), F.col("line")
    one = boxed(spark, d).select("doc_id", k.alias("layout_id"), F.when(k % 2 == 0, "paragraph").otherwise("table").alias("class_name"), "box", F.lit(0.9).alias("conf"))
    two = boxed(spark, d).select("doc_id", k.alias("layout_id"), F.when(k % 3 == 0, "title").otherwise("text").alias("class_name"), G.box(b["x"], b["y"] - 0.1, b["x2"], b["y2"]).alias("box"), F.lit(0.8).alias("conf"))
    return passes.hybrid_layout(one, two, ["doc_id"]).select("doc_id", "layout_id", "class_name", F.round("box.y", 6).alias("y"))


# Services.


@query("with c as (select l_partkey, l_suppkey, l_returnflag, max(l_orderkey * 10 + l_linenumber) as id from lineitem where l_linestatus = 'F' group by all) select distinct l.l_partkey as engine, l.l_suppkey as params, l.l_returnflag as text, case when c.id is not null then 't' || c.id end as translation from lineitem l left join c using (l_partkey, l_suppkey, l_returnflag)")
def cache_hits(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("engine"), F.col("l_suppkey").alias("params"), F.col("l_returnflag").alias("text"), "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    cache = l.where("l_linestatus = 'F'").select("id", "engine", "params", "text", F.concat(F.lit("t"), F.col("id").cast("string")).alias("translation"))
    return services.hits(l.select("engine", "params", "text").distinct(), cache)


@query("with c as (select o_orderkey as id, o_custkey as engine, o_orderpriority as params, o_orderstatus as text from orders where o_orderkey % 2 = 0), n as (select (select max(id) from c) + o_orderkey + 1 as id, o_custkey as engine, o_orderpriority as params, o_orderstatus as text from orders where o_orderkey % 2 = 1) select engine, params, text, max(id) as id from (select * from c union all select * from n) group by all")
def cache_upserts(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    cols = [F.col("o_custkey").alias("engine"), F.col("o_orderpriority").alias("params"), F.col("o_orderstatus").alias("text")]
    return services.upserted(o.where(k % 2 == 0).select(k.alias("id"), *cols), o.where(k % 2 == 1).select((k + 1).alias("seq"), *cols), "seq").select("engine", "params", "text", "id")


@query("with r as (select l_orderkey, min(l_quantity) as a, max(l_quantity) as b, min(l_partkey % 7)::double as c, max(l_partkey % 7)::double as e, count(*) as n from lineitem group by 1) select l_orderkey, n % 4 <> 3 and (case when n % 2 = 0 then a < b or c < e else false end) as improved from r")
def improved_rounds(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.min(F.col("l_partkey") % 7).cast("double").alias("c"), F.max(F.col("l_partkey") % 7).cast("double").alias("e"), F.count("*").alias("n"))
    before = F.array(F.when(F.col("n") % 4 != 3, F.when(F.col("n") % 2 == 0, F.col("b")).otherwise(F.col("a"))), F.when(F.col("n") % 2 == 0, F.col("e")).otherwise(F.col("c")))
    after = F.array(F.when(F.col("n") % 2 == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("n") % 2 == 0, F.col("c")).otherwise(F.col("e")))
    return r.select("l_orderkey", services.improved(before, after).alias("improved"))


@query("with c as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations) select conv_id, turn, right(text, 20) as before, left(nxt, 20) as after from c where nxt is not null")
def boundary_windows(spark, d):
    t = J.adjacent(table(spark, d, "conversations"), ["conv_id"], "turn", ["text"])
    return t.select("conv_id", "turn", services.windows_at(F.col("text"), F.col("next_text"), 20).alias("w")).select("conv_id", "turn", "w.before", "w.after")


@query("select conv_id as chain_id, count(*) as members, sum(length(text))::bigint as tokens, case when count(*) < 4 then 'single' else null end as few, case when count(*) < 2 then 'single' when bool_or(turn = 5) then 'blank_member' when sum(length(text)) > 2500 then 'too_long' end as refusal from conversations group by 1")
def chain_plans(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("chain_index"), F.when(F.col("turn") == 5, " ").otherwise(F.col("text")).alias("text"), F.length("text").alias("tokens"))
    return services.planned_chains(m, 2500).select("chain_id", "members", "tokens", F.when(F.col("members") < 4, "single").alias("few"), "refusal")


@query("with n as (select user_id, row_number() over (partition by user_id order by event_id) as sequence from events) select sequence from n where user_id = 3 and sequence > 4")
def replayed_events(spark, d):
    w = W.Window.partitionBy("user_id").orderBy("event_id")
    log = table(spark, d, "events").where("user_id = 3").select(F.col("user_id").cast("string").alias("execution_id"), F.row_number().over(w).cast("long").alias("sequence"))
    return services.replayed(log, "3", 4).select("sequence")


# Sources and sinks.


@query("select c_custkey, '<tr><td>' || c_name || ' &amp; &lt;b&gt;</td><td>' || c_mktsegment || '</td></tr>' as value from customer")
def review_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" & <b>")).alias("n"), "c_mktsegment")
    # html_rows() gives the rows alone; the key stands first in them and is cut off again.
    r = files.html_rows(c, ["c_custkey", "n", "c_mktsegment"])
    return r.select(F.regexp_extract("value", "<td>(\\d+)</td>", 1).cast("long").alias("c_custkey"), F.regexp_replace("value", "^<tr><td>\\d+</td>", "<tr>").alias("value"))


@query("select '| n_name | n_regionkey |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' |', chr(10) order by n_name) as value from nation")
def report_table(spark, d):
    return files.markdown_table(table(spark, d, "nation").select("n_name", "n_regionkey"), ["n_name"])


@query("select p_brand as file, p_partkey::int as page, case when p_size % 2 = 0 then p_type else p_type || ',other' end as accepted from part")
def accepted_labels(spark, d):
    p = table(spark, d, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.to_json(F.array("p_type", F.lit("other"))))
    pages = F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), raw)))
    text = p.groupBy("p_brand").agg(pages.alias("m")).select(F.to_json(F.create_map("p_brand", "m")).alias("value"))
    return files.page_labels(text).select("file", "page", F.array_join("accepted", ",").alias("accepted"))


@query("select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey % 100 end::int as tail_page, case when o_orderkey % 3 > 0 then o_custkey end::int as head_page from orders")
def boundary_keys(spark, d):
    k = F.col("o_orderkey")
    key = F.concat(F.lit(" "), (k % 100).cast("string"), F.when(k % 3 == 0, "-").when(k % 3 == 1, " -> ").otherwise("->"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", files.boundary(key).alias("b")).select("o_orderkey", "b.*")


@query("with e as (select p_name as path, max(case when p_size > 5 then p_brand end) as publication, count(*) as n from part where p_partkey % 2 = 0 group by 1), f as (select p_name as path, min(p_size)::varchar as sha256 from part where p_partkey % 3 > 0 group by 1), m as (select p_name as path, min(p_size)::varchar as w from part group by 1) select path, 'duplicate' as fault from e where n > 1 union all select path, 'no_publication' from e where publication is null union all select path, 'missing' from e where path not in (select path from f) union all select path, 'unlisted' from f where path not in (select path from e) union all select path, 'changed' from m join f using (path) where w <> sha256")
def registry_checks(spark, d):
    p, one = table(spark, d, "part").withColumnRenamed("p_name", "path"), F.min("p_size").cast("string")
    listed = p.where("p_partkey % 2 = 0")
    known = listed.groupBy("path").agg(F.max(F.when(F.col("p_size") > 5, F.col("p_brand"))).alias("publication"), F.count("*").alias("n"))
    twice = known.where("n > 1").select("path", F.lit("x").alias("publication"))
    on_disk = p.where("p_partkey % 3 > 0").groupBy("path").agg(one.alias("sha256"))
    return files.registry_faults(known.select("path", "publication").unionByName(twice), on_disk, p.groupBy("path").agg(one.alias("sha256"))).distinct()


@query("with l as (select p_brand as file, p_partkey as page, p_type as kind from part) select file, page, 'type:' || kind as fault from l where kind not in ('ECONOMY', 'STANDARD') union all select file, page, 'page' from l where page % 5 = 0")
def label_faults(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("page"), F.array("p_type").alias("accepted"))
    return files.unknown_labels(p, ["ECONOMY", "STANDARD"], p.where("page % 5 > 0").select("file", "page"))


@query("select p_partkey as page_number, side, case when side = 0 then p_name else p_type end as text from part, (values (0), (1)) s(side) where side = 0 or p_partkey % 3 > 0")
def alternating_pages(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "page_number")
    return files.interleaved(p.select("page_number", F.col("p_name").alias("text")), p.where("page_number % 3 > 0").select("page_number", F.col("p_type").alias("text"))).select("page_number", "side", "text")


@query("select p_partkey as page_number, case when p_partkey % 4 > 0 then p_name end as original, case when p_partkey % 3 > 0 then p_type end as translated from part where p_partkey % 4 > 0 or p_partkey % 3 > 0")
def facing_pages(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "page_number")
    s = files.side_by_side(p.where("page_number % 4 > 0").select("page_number", F.col("p_name").alias("text")), p.where("page_number % 3 > 0").select("page_number", F.col("p_type").alias("text")))
    return s.select("page_number", F.col("original.text").alias("original"), F.col("translated.text").alias("translated"))


@query("with s as (select o_custkey % 7 as part, count(*) as n from orders group by 1), b as (select part, coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as b from s), p as (select o_orderkey, o_custkey % 7 as part, row_number() over (partition by o_custkey % 7 order by o_orderkey) - 1 as page from orders) select o_orderkey, (page + b)::bigint as page_number from p join b using (part)")
def merged_page_numbers(spark, d):
    part = F.col("o_custkey") % 7
    o = table(spark, d, "orders").select("o_orderkey", part.alias("part"), (F.row_number().over(W.Window.partitionBy(part).orderBy("o_orderkey")) - 1).cast("long").alias("page_number"))
    return files.merged_parts(o, ["page_number"])[0].select("o_orderkey", "page_number")


# Content streams: a part is a page that shows its name, in a form of its own where its number is odd.

TEXT = "shown as (select p_partkey, p_name, (p_size % 9 + 4) as size, p_partkey % 50 as x, p_size as y from part)"


def streams(spark: SparkSession, d: str, before: str = "") -> DataFrame:
    size, x = (F.col("p_size") % 9 + 4).cast("string"), (F.col("p_partkey") % 50).cast("string")
    s = F.concat(F.lit(before + "BT /F1 "), size, F.lit(" Tf "), x, F.lit(" "), F.col("p_size").cast("string"), F.lit(" Td ("), "p_name", F.lit(") Tj ET"))
    return table(spark, d, "part").select("p_partkey", F.encode(s, "utf-8").alias("content"))


@query(f"with {TEXT} select p_partkey, unnest([0, 1, 2, 3, 4]) as seq, unnest(['BT', 'Tf', 'Td', 'Tj', 'ET']) as operator, unnest(['[]', '[\"/F1\", ' || size || ']', '[' || x || ', ' || y || ']', '[{{\"hex\": \"' || lower(hex(encode(p_name))) || '\"}}]', '[]']) as operands from shown")
def content_operations(spark, d):
    return content.operations_of(streams(spark, d), ["p_partkey"])


@query(f"with {TEXT} select p_partkey, lower(hex(encode(p_name))) as codes, '/F1' as font, size::double as font_size, 2.0::double as a, (2 * x + 7)::double as e, (3 * y + 9)::double as f from shown")
def content_text_runs(spark, d):
    ops = content.operations_of(streams(spark, d, "q 2 0 0 3 7 9 cm "), ["p_partkey"])
    return content.text_runs(ops, ["p_partkey"]).select("p_partkey", "codes", "font", "font_size", "a", "e", "f")


@query(f"with {TEXT} select p_partkey, i::int as pos, substring(p_name, i + 1, 1) as unicode, (x + 0.5 * size * i)::double as x, (x + 0.5 * size * (i + 1))::double as x2, (y - 0.2 * size)::double as y, (y + 0.8 * size)::double as y2 from shown, range(0, 60) r(i) where i < length(p_name)")
def content_glyphs(spark, d):
    runs = content.text_runs(content.operations_of(streams(spark, d), ["p_partkey"]), ["p_partkey"])
    widths = spark.range(32, 127).select(F.lit("/F1").alias("font"), F.col("id").cast("int").alias("code"), F.chr("id").alias("unicode"), F.lit(500.0).alias("width"), F.lit(800.0).alias("ascent"), F.lit(-200.0).alias("descent"))
    g = content.glyphs(runs, widths, ["p_partkey"])
    return g.select("p_partkey", "pos", "unicode", *[F.round(f"box.{c}", 6).alias(c) for c in ("x", "x2", "y", "y2")])


@query(f"with {TEXT}, g as (select p_partkey, i::int as pos, substring(p_name, i + 1, 1) as u from shown, range(0, 60) r(i) where i < length(p_name)) select p_partkey, count(*) as n from g where u = ' ' or u < 'n' group by 1")
def content_valid_characters(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit("\x07")), "")).alias("unicode")).withColumn("font", F.lit("f"))
    mapped = spark.range(0, 110).select(F.lit("f").alias("font"), F.chr("id").alias("unicode")).unionByName(spark.createDataFrame([("f", "")], "font string, unicode string"))
    return content.valid_chars(t, mapped).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("with p as (select p_partkey, p_partkey % 2 = 1 as form from part) select p_partkey, count(*) as operations from (select p_partkey, unnest(case when form then ['q', 'BT', 'Tf', 'Td', 'Tj', 'ET', 'Q'] else ['q', 'Do', 'Q'] end) as op from p) group by 1")
def content_forms(spark, d):
    key = ["p_partkey"]
    page = table(spark, d, "part").select("p_partkey", F.encode(F.lit("q /X1 Do Q"), "utf-8").alias("content"))
    forms = content.operations_of(streams(spark, d).where("p_partkey % 2 = 1"), key).withColumn("name", F.lit("/X1"))
    return content.with_forms(content.operations_of(page, key), forms, key).groupBy("p_partkey").agg(F.count("*").alias("operations"))


@query("select p_partkey, p_size as code, chr(97 + p_size % 26) as unicode from part union all select p_partkey, 100 + i, chr(65 + i::int) from part, range(0, 3) r(i)")
def content_code_maps(spark, d):
    h = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    s = F.concat(F.lit("1 beginbfchar\n<"), h(F.col("p_size"), 2), F.lit("> <"), h(97 + F.col("p_size") % 26, 4), F.lit(">\nendbfchar\n1 beginbfrange\n<64> <66> <0041>\nendbfrange"))
    return table(spark, d, "part").select("p_partkey", F.explode(content.to_unicode(F.encode(s, "utf-8"))).alias("code", "unicode"))


# Streams.


@query("select user_id::varchar as execution_id, round(100 * sum(value * least(greatest(event_id % 7, 0) / 5.0, 1)) / nullif(sum(value), 0), 6) as progress from events group by 1")
def overall_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("execution_id"), F.col("event_type").alias("stage"), F.col("value").alias("weight"), (F.col("event_id") % 7).alias("done"), F.lit(5).alias("total"))
    return S.progress(e).withColumn("progress", F.round("progress", 6))


@query("select user_id || '-' || event_id % 400 as execution_id, max(event_id) + 1 as sequence, 'error' as type from events group by 1 having not bool_or(event_type = 'error')")
def unfinished_executions(spark, d):
    name = F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 400).cast("string"))
    log = table(spark, d, "events").select(name.alias("execution_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("type"))
    return S.unfinished(log).select("execution_id", "sequence", "type")


# Characters.


@query("with c as (select p_partkey, i::int as i, substring(replace(p_name, ' ', ''), i + 1, 1) as u, sum(case when i % 4 = 0 then 12 else 5 end) over (partition by p_partkey order by i) as x from part, range(0, 60) r(i) where i < length(replace(p_name, ' ', ''))), g as (select *, x - (lag(x) over w + 5) as gap from c window w as (partition by p_partkey order by i)) select p_partkey, string_agg(case when gap > 1 then ' ' else '' end || u, '' order by i) as text from g group by 1")
def spaced_texts(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    c = table(spark, d, "part").select("p_partkey", F.posexplode(F.split(name, "")).alias("i", "unicode")).where("unicode != ''")
    x = F.sum(F.when(F.col("i") % 4 == 0, 12.0).otherwise(5.0)).over(W.Window.partitionBy("p_partkey").orderBy("i"))
    c = c.withColumn("_x", x).select("p_partkey", "i", "unicode", G.box(F.col("_x"), 0, F.col("_x") + 5, 10).alias("box"))
    return C.texts(c, ["p_partkey"], "i")


@query("with c as (select p_partkey, unnest(regexp_extract_all(p_name || '+α7[•(', '(?s).')) as u from part) select p_partkey, count_if(u <> ' ' and (regexp_matches(u, '^[0-9\\[\\]•]') or u in ('+', 'α') or u = 'q' or u = 'w'))::bigint as starts from c group by 1")
def formula_starts(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit("+α7[•(")), "")).alias("u")).where("u != ''")
    u = F.col("u")
    return c.groupBy("p_partkey").agg(F.count_if(C.begins_formula(u, u != "q", "w")).alias("starts"))


@query("select p_partkey, case when p_size % 2 = 0 then upper(substring(p_name, 1, 1)) || substring(p_name, 2) else 'A  ' || upper(p_name) end as text, case when p_size % 2 = 0 then 2.0 else 0.0 end::double as y from part")
def closed_initials(spark, d):
    even = F.col("p_size") % 2 == 0
    first = F.upper(F.substring("p_name", 1, 1))
    p = table(spark, d, "part").select("p_partkey", F.when(even, F.concat(first, F.lit("  "), F.expr("substring(p_name, 2)"))).otherwise(F.concat(F.lit("A  "), F.upper("p_name"))).alias("text"), F.when(even, first).otherwise("A").alias("initial"), G.box(0, 0, 9, 20).alias("box"), G.box(1, 2, 8, 18).alias("body_box"))
    return C.flattened_initials(p).select("p_partkey", "text", "box.y")


@query("with w as (select p_partkey, (p_size * 10)::double as width, 200.0 as room from part), s as (select *, round(1 - greatest(ceil(round((1 - room / nullif(width, 0)) / 0.05, 9)), 0) * 0.05, 6) as s from w) select p_partkey, case when width > 0 and s >= 0.5 then s when width = 0 then 1.0 end as scale from s")
def heading_scales(spark, d):
    return C.single_line_scale(table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).cast("double").alias("width"), F.lit(200.0).alias("room"))).select("p_partkey", "scale")


@query("select p_partkey, case when p_size % 2 = 0 then 1 + p_size % 3 end::int as after from part")
def repeated_headings(spark, d):
    n = F.col("p_size") % 3
    own = F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), n + 1)
    runs = F.when(F.col("p_size") % 2 == 0, F.concat(own, F.array(F.upper(F.array_join(own, " "))))).otherwise(F.concat(own, F.array("p_name")))
    return table(spark, d, "part").select("p_partkey", C.repeats_at(runs).alias("after"))


@query("select doc_id, case when lang in ('de', 'fr') then 'roman' when lang = 'en' and doc_id % 2 = 0 then 'british' when lang = 'en' then 'english' else 'default' end as profile from documents where doc_id is not null")
def language_profile_rows(spark, d):
    tag = F.when((F.col("lang") == "en") & (F.col("doc_id") % 2 == 0), "EN_GB").when(F.col("lang") == "en", "en-US").when(F.col("lang") == "de", "de_AT").otherwise(F.col("lang"))
    prefixes = spark.createDataFrame([("de", "roman"), ("fr", "roman"), ("en", "english"), ("en-gb", "british")], "prefix string, profile string")
    return C.language_profiles(table(spark, d, "documents").where("doc_id is not null").select("doc_id", tag.alias("language")), prefixes, "default").select("doc_id", "profile")


@query("with b as (select o_custkey as page, o_orderstatus as kind, count(*) as n from orders where o_orderkey % 2 = 0 group by all), a as (select o_custkey as page, o_orderstatus as kind, count(*) as n from orders where o_orderkey % 2 = 1 group by all), w as (select distinct page from a left join b using (page, kind) where a.n > coalesce(b.n, 0)) select c_custkey as page, case when c_custkey in (select page from w) then 'before' else 'after' end as state from customer")
def rolled_back_pages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("kind"), "o_orderkey")
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("page"))
    return C.rolled_back(p.withColumn("state", F.lit("before")), p.withColumn("state", F.lit("after")), o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["page"])


# Files of pages: parts are pages of their brand's document.


def brand_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = (F.row_number().over(W.Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("page_number")
    stream = F.concat(F.lit("BT /F1 9 Tf "), (F.col("p_partkey") % 50).cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" Td ("), "p_name", F.lit(") Tj ET"))
    return p.select("p_brand", n, (200.0 + F.col("p_size")).alias("width"), F.lit(300.0).alias("height"), stream.alias("stream"))


PAGED = "paged as (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as page_number from part)"


@query(f"with {PAGED} select p_brand, page_number::int as page_number, lower(hex(encode(p_name))) as codes, (p_partkey % 50)::double as e, p_size::double as f from paged")
def pdf_texts(spark, d):
    pages = pdf.pages_of(pdf.documents_of(brand_pages(spark, d), ["p_brand"]).withColumnRenamed("pdf", "content"), ["p_brand"])
    key = ["p_brand", "page_number"]
    return content.text_runs(content.operations_of(pages, key), key).select(*key, "codes", "e", "f")


@query(f"with {PAGED} select p_brand, page_number::int as page_number, (200 + p_size)::double as width, 300.0::double as height, null::varchar as corrupt from paged union all select 'damaged', null, null, null, 'Refused: no PDF header'")
def pdf_geometry(spark, d):
    files_ = pdf.documents_of(brand_pages(spark, d), ["p_brand"]).withColumnRenamed("pdf", "content")
    damaged = spark.range(1).select(F.lit("damaged").alias("p_brand"), F.encode(F.lit("no file"), "utf-8").alias("content"))
    p = pdf.pages_of(files_.unionByName(damaged), ["p_brand"], geometry=True)
    return p.select("p_brand", "page_number", F.col("media")[2].alias("width"), F.col("media")[3].alias("height"), "corrupt")


@query(f"with {PAGED} select p_brand, (2 * page_number + s)::int as page_number, (200 + p_size)::double as width from paged, (values (0), (1)) t(s)")
def pdf_dual_pages(spark, d):
    p = brand_pages(spark, d)
    both = pdf.documents_of(pdf.dual_pages(p, p.withColumn("stream", F.lit("BT ET")), ["p_brand"]), ["p_brand"])
    return pdf.pages_of(both.withColumnRenamed("pdf", "content"), ["p_brand"]).select("p_brand", "page_number", F.col("media")[2].alias("width"))


@query(f"with {TEXT}, w as (select p_partkey, size, x, unnest(string_split(p_name, ' ')) as text, p_name from shown) select p_partkey, text, round(x + 0.5 * size * (strpos(p_name, text) - 1), 6)::double as x from w")
def glyph_words(spark, d):
    runs = content.text_runs(content.operations_of(streams(spark, d), ["p_partkey"]), ["p_partkey"])
    widths = spark.range(32, 127).select(F.lit("/F1").alias("font"), F.col("id").cast("int").alias("code"), F.chr("id").alias("unicode"), F.lit(500.0).alias("width"), F.lit(800.0).alias("ascent"), F.lit(-200.0).alias("descent"))
    return C.words_of(content.glyphs(runs, widths, ["p_partkey"]), ["p_partkey"], ["run", "part", "pos"]).select("p_partkey", "text", F.round("box.x", 6).alias("x"))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of 16 x 8 pixels with a white rectangle of 4 x 3 whose place the part's numbers give."""
    x, y = F.col("p_partkey") % 12, F.col("p_size") % 5
    row = F.concat(F.repeat(F.lit("00"), x), F.lit("ff" * 4), F.repeat(F.lit("00"), 12 - x))
    image = F.unhex(F.concat(F.repeat(F.lit("00" * 16), y), F.repeat(row, F.lit(3)), F.repeat(F.lit("00" * 16), 5 - y)))
    return table(spark, d, "part").select("p_partkey", "p_size", image.alias("image"), F.lit(16).alias("width"), F.lit(8).alias("height"))


def bright_boxes():
    """A detector of the bright part of an image; its second finding has too little confidence."""
    import numpy as np

    def predict(images):
        out = []
        for m in images > 0.5:
            ys, xs = np.nonzero(m)
            box = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
            out.append([(*box, 0.9, 1), (*box, 0.1, 0)])
        return out

    return predict


@query("select p_partkey, 0 as layout_id, 'figure' as class_name, (p_partkey % 12)::double as x, (8 - 3 - p_size % 5)::double as y, (p_partkey % 12 + 4)::double as x2, (8 - p_size % 5)::double as y2 from part")
def detected_layouts(spark, d):
    return passes.detected(page_images(spark, d), ["p_partkey"], bright_boxes, ["text", "figure"], side=64).select("p_partkey", "layout_id", "class_name", "box.x", "box.y", "box.x2", "box.y2")


@query("select p_partkey, p_size % 3 = 0 as is_scanned from part where p_size % 4 > 0 union all select p_partkey, null from part where p_size % 4 = 0")
def scanned_pages(spark, d):
    i = page_images(spark, d)
    empty = F.unhex(F.lit("00" * 128))
    both = i.select("p_partkey", F.col("image").alias("whole"), F.when(F.col("p_size") % 4 > 0, F.when(F.col("p_size") % 3 == 0, F.col("image")).otherwise(empty)).alias("textless"), "width")
    return passes.scan_pages(both).select("p_partkey", "is_scanned")


@query("select o_custkey, count_if((o_orderstatus = 'F') or o_orderkey % 3 = 0) > 0.6 * count(*) as scanned from orders group by 1")
def marked_scans(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("invisible"), (F.col("o_orderkey") % 3 == 0).alias("artifact"))
    return passes.marked_scans(o, ["o_custkey"], 0.6)


def rule_client():
    """A client that answers by a rule: no JSON on the first try for some prompts, never for others."""
    tried: dict[str, int] = {}

    def ask(prompt: str) -> str:
        n = tried[prompt] = tried.get(prompt, 0) + 1
        if prompt.startswith("STANDARD") or (prompt.startswith("ECONOMY") and n == 1):
            return "I think"
        return '{"action": "%s", "size": %d}' % ("slide" if len(prompt) % 2 else "shrink", len(prompt))

    return ask


@query("with p as (select distinct p_type || ' ' || p_size as prompt from part) select prompt, case when prompt like 'STANDARD 1%' then 'kept' when prompt like 'STANDARD%' then null when length(prompt) % 2 = 1 then 'slide' else 'shrink' end as action from p")
def cached_decisions(spark, d):
    asked = table(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("prompt")).distinct()
    cache = asked.where("prompt like 'STANDARD 1%'").select(R.cache_digest(F.col("prompt")).alias("digest"), F.lit('{"action": "kept", "size": 1}').alias("reply"))
    answers, _ = passes.cached_answers(asked, cache, rule_client, "prompt", "action string, size int", save=lambda df: df)
    return answers.select("prompt", "reply.action")


# Files: written in the folder that driver and executors share, then read again.


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or in a temporary one where everything runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = f"file://{tempfile.gettempdir()}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@query("select p_name || ', \"' || p_partkey || '\"' as source, p_type as target, case when p_size % 3 = 0 then 'zh-CN' end as tgt_lng from part where p_size % 3 <> 1")
def glossary_files(spark, d):
    size = F.col("p_size") % 3
    p = table(spark, d, "part").select(F.concat("p_name", F.lit(', "'), F.col("p_partkey").cast("string"), F.lit('"')).alias("source"), F.col("p_type").alias("target"), F.when(size == 0, "zh-CN").when(size == 1, "fr").alias("tgt_lng"))
    path = scratch(spark, "glossary")
    files.write_glossary(p, path)
    return files.glossary(spark, path, "ZH_cn")


@query("select l_orderkey::int as page_number, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1)::int as par_idx, 'p' || l_linenumber || '-' || l_partkey as debug_id, l_shipdate::date || ' & <' || l_returnflag || '>' as text, l_quantity as x2 from (select distinct l_orderkey, l_linenumber, l_partkey, any_value(l_shipdate) as l_shipdate, any_value(l_returnflag) as l_returnflag, any_value(l_quantity) as l_quantity from lineitem group by l_orderkey, l_linenumber, l_partkey having count(*) = 1)")
def document_trees(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("l_shipdate", "l_returnflag", "l_quantity")]).where("n = 1")
    box = F.struct(F.lit(0.0).alias("_x"), F.lit(0.0).alias("_y"), F.col("l_quantity").alias("_x2"), F.lit(9.0).alias("_y2"))
    text = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" & <"), "l_returnflag", F.lit(">"))
    par = F.struct("l_linenumber", "l_partkey", F.struct(text.alias("_unicode"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("_debug_id"), box.alias("box")).alias("p"))
    pages = t.groupBy(F.col("l_orderkey").cast("int").alias("_pageNumber")).agg(F.transform(F.array_sort(F.collect_list(par)), lambda x: x["p"]).alias("pdfParagraph"))
    path = scratch(spark, "tree")
    pages.write.format("xml").option("rootTag", "document").option("rowTag", "page").save(path)
    got = files.checked_pages(files.tree_pages(spark, path), pages.count())
    return files.paragraphs_of(got).select("page_number", "par_idx", "debug_id", "text", "box.x2")


@query("select n_nationkey, n_name as name, n_regionkey as region from nation union all select 100, 'absent', 0 where false")
def sidecar_reports(spark, d):
    path, kind = scratch(spark, "sidecar"), "n_nationkey int, name string, region int"
    files.write_sidecar(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    written = spark.read.schema(kind).json(path)
    return written.unionByName(files.sidecar(spark, f"{path}-absent", kind))


@query("select n_regionkey::bigint as section, n_name as source, 'keep ' || n_nationkey as decision from nation")
def ruling_files(spark, d):
    r = table(spark, d, "nation").select(F.struct(F.col("n_regionkey").cast("long").alias("section"), F.col("n_name").alias("source"), F.concat(F.lit("keep "), F.col("n_nationkey").cast("string")).alias("decision")).alias("r"))
    path = scratch(spark, "rulings")
    r.groupBy().agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(path)
    return files.json_table(spark, path, "section long, source string, decision string", strict=True)


@query("select n_name as name, sha256(n_name || ' prompt') as sha256 from nation union all select r_name, sha256(r_name) from region")
def prompt_manifests(spark, d):
    path = scratch(spark, "manifest")
    files.append_manifest(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" prompt")).alias("content")), path)
    files.append_manifest(table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_name").alias("content")), path)
    return spark.read.parquet(path)


@query("select sha256(string_agg(n_name, chr(10) order by n_nationkey) || chr(10)) as sha256, 1::bigint as files from nation")
def file_digest(spark, d):
    path = scratch(spark, "text")
    table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    found = R.file_digests(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path))
    return found.groupBy("sha256").agg(F.count("*").alias("files"))


@query("select p_partkey, p_name, 3 as number from part")
def stage_checkpoints(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    path = files.write_checkpoint(p, scratch(spark, "checkpoints"), 3, "paragraphs")
    assert files.write_checkpoint(p, path, 4, "off", enabled=False) is None
    return spark.read.parquet(path).withColumn("number", F.regexp_extract(F.lit(path), r"/(\d+)_paragraphs$", 1).cast("int"))


# Folds over more than a row before.


@query("with recursive a as (select distinct o_custkey as doc, o_orderkey % 37 as article, case when o_orderkey % 2 = 0 then o_orderkey % 5 end as chain from orders), e as (select distinct x.doc, x.article as p, y.article as q from a x join a y on x.doc = y.doc and x.chain = y.chain), r as (select distinct doc, article as p, article as q from a union select r.doc, r.p, e.q from r join e on e.doc = r.doc and e.p = r.q) select doc, p as article, min(q) as merged from r group by all")
def merged_articles(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (k % 37).alias("article"), F.when(k % 2 == 0, k % 5).alias("chain_id")).distinct()
    return folds.components_of_pages(o, ["doc"])


@query("with recursive b as (select distinct p_brand, p_partkey % 23 as r, p_size as c from part), w as (select p_brand, r, c, r as r2, c as c2 from b union select w.p_brand, w.r, w.c, b.r, b.c from w join b on b.p_brand = w.p_brand and abs(b.r - w.r2) <= 1 and abs(b.c - w.c2) <= 1), m as (select p_brand, r, c, min(r2 * 100 + c2) as root from w group by all) select p_brand, count(distinct root) as regions from m group by 1")
def changed_regions(spark, d):
    b = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 23).alias("row"), F.col("p_size").alias("col")).distinct()
    return folds.region_count(b, ["p_brand"])


@query("with recursive n as (select conv_id, turn, substring(text, 1, 30) as t, turn % 7 = 5 as wall, row_number() over (partition by conv_id order by turn) as k from conversations), s as (select conv_id, turn, k, t as left_, wall, 0::bigint as unit from n where k = 1 union all select n.conv_id, n.turn, n.k, case when n.wall or s.wall or right(rtrim(s.left_, '\"''”’)] '), 1) in ('.', '!', '?', '。', '！', '？', '…') or least(length(s.left_), length(n.t)) > 29 then n.t else s.left_ || ' ' || n.t end, n.wall, case when n.wall or s.wall or right(rtrim(s.left_, '\"''”’)] '), 1) in ('.', '!', '?', '。', '！', '？', '…') or least(length(s.left_), length(n.t)) > 29 then s.unit + 1 else s.unit end from s join n on n.conv_id = s.conv_id and n.k = s.k + 1) select conv_id, turn, unit from s")
def stitched_units(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 30).alias("text"), (F.col("turn") % 7 == 5).alias("barrier"))
    return folds.stitched(t, ["conv_id"], ["turn"], 29).select("conv_id", "turn", "unit")


@query("with recursive n as (select l_orderkey, l_linenumber, l_partkey % 3 as lay, case l_linenumber % 4 when 0 then ' ' when 1 then '.' else 'a' end as u, case when l_suppkey % 5 = 0 then 1 end as form, row_number() over (partition by l_orderkey order by l_linenumber) as k from (select l_orderkey, l_linenumber, any_value(l_partkey) as l_partkey, any_value(l_suppkey) as l_suppkey from lineitem group by all having count(*) = 1)), s as (select l_orderkey, l_linenumber, k, 0::bigint as par, lay, form from n where k = 1 union all select n.l_orderkey, n.l_linenumber, n.k, case when n.u <> '.' and ((n.lay <> s.lay and n.u <> ' ') or n.form is distinct from s.form) then s.par + 1 else s.par end, case when n.u <> '.' and ((n.lay <> s.lay and n.u <> ' ') or n.form is distinct from s.form) then n.lay else s.lay end, n.form from s join n on n.l_orderkey = s.l_orderkey and n.k = s.k + 1) select l_orderkey, l_linenumber, par as par_idx from s")
def character_paragraphs(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_partkey").alias("pk"), F.first("l_suppkey").alias("sk")).where("n = 1")
    m = F.col("l_linenumber") % 4
    c = t.select("l_orderkey", "l_linenumber", (F.col("pk") % 3).alias("layout_id"), F.when(m == 0, " ").when(m == 1, ".").otherwise("a").alias("unicode"), F.when(F.col("sk") % 5 == 0, 1).alias("xobj_id"), F.lit(50.0).alias("area"))
    return C.paragraphs_of(c, ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "par_idx")
