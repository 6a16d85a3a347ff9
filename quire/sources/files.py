"""Scans of trees, glossaries, labels, rulings and sidecars, and the sinks beside them. All paths are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LABELS = "map<string, map<string, array<string>>>"
BOX_XML = "struct<_x: double, _y: double, _x2: double, _y2: double>"
PAGES_XML = f"_pageNumber int, _pageKind string, cropbox struct<box: {BOX_XML}>, pdfParagraph array<struct<_unicode: string, _debug_id: string, _layout_label: string, box: {BOX_XML}>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def tree_pages(spark: SparkSession, path: str, schema: str = PAGES_XML, row_tag: str = "page") -> DataFrame:
    """Pages of a document tree in XML, a row each."""
    return spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)


def paragraphs_of(pages: DataFrame) -> DataFrame:
    """A row for each paragraph of tree_pages(), with its place on its page."""
    p = pages.select(F.col("_pageNumber").alias("page_number"), F.posexplode("pdfParagraph").alias("par_idx", "p"))
    b = F.col("p.box")
    box = F.struct(*[b[f"_{c}"].alias(c) for c in ("x", "y", "x2", "y2")])
    return p.select("page_number", "par_idx", F.col("p._debug_id").alias("debug_id"), F.col("p._unicode").alias("text"), F.col("p._layout_label").alias("layout_label"), box.alias("box"))


def checked_pages(pages: DataFrame, total: int) -> DataFrame:
    """pages, or an error where they are not as many as the document says."""
    n = pages.agg(F.count("*").alias("_n"))
    ok = F.assert_true(F.col("_n") == total, F.concat(F.lit(f"expected {total} pages, found "), F.col("_n")))
    return pages.join(F.broadcast(n.where(ok.isNull())), F.lit(True), "left_semi")


def glossary(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """source, target, tgt_lng of a CSV file with quotes; entries of other languages go, those of none stay."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    for c in ("source", "target"):
        if c not in rows.columns:
            raise ValueError(f"a glossary needs a column {c}")
    if "tgt_lng" not in rows.columns:
        rows = rows.withColumn("tgt_lng", F.lit(None).cast("string"))
    form = lambda c: F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    rows = rows.select("source", "target", "tgt_lng").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    if language is None:
        return rows
    return rows.where(F.col("tgt_lng").isNull() | (F.trim("tgt_lng") == "") | (form(F.col("tgt_lng")) == form(F.lit(language))))


def json_table(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON document; strict: refused as a whole on any fault."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A pass's report, empty where it wasn't written."""
    return json_table(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def page_labels(text: DataFrame, value: str = "value") -> DataFrame:
    """(file, page, accepted) of a JSON text file -> page -> a type or a list of types."""
    files = text.select(F.explode(F.from_json(value, "map<string, map<string, string>>")).alias("file", "pages"))
    rows = files.select("file", F.explode("pages").alias("page", "raw"))
    accepted = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    return rows.select("file", F.col("page").try_cast("int").alias("page"), accepted.alias("accepted"))


def boundary(key: Column) -> Column:
    """"N->M" as struct<tail_page, head_page>; null parts where it isn't that."""
    p = F.split(key, r"\s*->\s*")
    ok = key.rlike(r"^\s*\d+\s*->\s*\d+\s*$")
    return F.struct(F.when(ok, F.trim(p[0])).try_cast("int").alias("tail_page"), F.when(ok, F.trim(p[1])).try_cast("int").alias("head_page"))


def registry_faults(entries: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault): keys twice, missing fields, missing or unlisted files, changed digests."""
    twice = entries.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("fault"))
    blank = entries.where("publication is null or trim(publication) = ''").select("path", F.lit("no_publication").alias("fault"))
    gone = entries.join(files, "path", "left_anti").select("path", F.lit("missing").alias("fault"))
    extra = files.join(entries, "path", "left_anti").select("path", F.lit("unlisted").alias("fault"))
    moved = manifest.withColumnRenamed("sha256", "_was").join(files, "path").where("_was != sha256").select("path", F.lit("changed").alias("fault"))
    return twice.unionByName(blank).unionByName(gone).unionByName(extra).unionByName(moved)


def unknown_labels(labels: DataFrame, kinds: list[str], pages: DataFrame) -> DataFrame:
    """Labels of unknown types or of pages that aren't there."""
    odd = labels.select("file", "page", F.explode("accepted").alias("kind")).where(~F.col("kind").isin(kinds)).select("file", "page", F.concat(F.lit("type:"), "kind").alias("fault"))
    return odd.unionByName(labels.join(pages, ["file", "page"], "left_anti").select("file", "page", F.lit("page").alias("fault")))


# Sinks.


def write_checkpoint(df: DataFrame, folder: str, number: int, stage: str, enabled: bool = True) -> str | None:
    path = f"{folder}/{number:02d}_{stage}"
    if enabled:
        df.write.mode("overwrite").parquet(path)
    return path if enabled else None


def write_glossary(terms: DataFrame, path: str) -> None:
    terms.select("source", "target", "tgt_lng").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_sidecar(df: DataFrame, path: str) -> None:
    """One JSON file of a report, whose rows are bounded by its document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_manifest(contents: DataFrame, path: str) -> None:
    """(name, sha256) of the prompts or settings (name, content) that a run used."""
    contents.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")).write.mode("append").parquet(path)


def interleaved(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages of both in turns, original first."""
    both = original.withColumn("side", F.lit(0)).unionByName(translated.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("page_number", "side")


def side_by_side(original: DataFrame, translated: DataFrame) -> DataFrame:
    return original.select("page_number", F.struct(*original.columns).alias("original")).join(translated.select("page_number", F.struct(*translated.columns).alias("translated")), "page_number", "full").orderBy("page_number")


def merged_parts(parts: DataFrame, counters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages of all parts numbered through in part order, and the counters' sums."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a part
    pages = parts.join(F.broadcast(before.select("part", "_before")), "part").withColumn("page_number", F.col("page_number") + F.col("_before")).drop("_before")
    return pages, parts.agg(*[F.sum(c).alias(c) for c in counters])


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a report table; df is a report and small."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"]), "\n")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return df.agg(F.concat(F.lit(head), body).alias("value"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's rows as HTML table rows, with the five marks escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return df.select(F.concat(F.lit("<tr>"), *[x for c in columns for x in (F.lit("<td>"), safe(c), F.lit("</td>"))], F.lit("</tr>")).alias("value"))
