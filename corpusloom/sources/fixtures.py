"""Golden test cases: line-oriented fixture files as rows, normalising, comparing, rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import body_of, difference_hint, normalize_paragraphs, strip_annotations, strip_transclusion_spans, trim_all
from ..operators.blocks import wt2html

MARK = r"^!!\s*([A-Za-z][\w/+*-]*)\s*$"
STARTS = ("test", "article")
SECTIONS = {"html/parsoid": "html_parsoid", "html/parsoid+integrated": "html_integrated", "html": "html_php", "html/*": "html_php", "html/php": "html_php", "wikitext": "wikitext", "wikitext/edited": "wikitext_edited", "options": "options_raw", "text": "text", "config": "config"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, s of fixture files. A file is small; files are the unit of work."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r?\n", -1)).alias("line", "s"))


def cases(lines: DataFrame) -> DataFrame:
    """path, line_number, kind (test or article), title, and a column for each section.

    Markers split the lines into islands; # lines are comments only outside sections.
    """
    w = Window.partitionBy("path").orderBy("line")
    mark = F.lower(F.regexp_extract("s", MARK, 1))
    rows = lines.withColumn("mark", F.nullif(mark, F.lit("")))
    rows = rows.withColumn("case_no", F.sum(F.col("mark").isin(*STARTS).cast("int")).over(w)).withColumn("section", F.last("mark", True).over(w))
    body = rows.where("mark is null and section is not null and section not in ('end', 'endarticle', 'options_end')").where("case_no > 0")
    text = body.groupBy("path", "case_no", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("text"))
    heads = rows.where(F.col("mark").isin(*STARTS)).select("path", "case_no", F.col("mark").alias("kind"), (F.col("line") + 1).alias("line_number"))
    names = ["test", "article", *SECTIONS]
    wide = text.groupBy("path", "case_no").pivot("section", names).agg(F.first("text"))
    out = heads.join(wide, ["path", "case_no"], "left")
    columns = {}
    for section, name in SECTIONS.items():
        columns.setdefault(name, []).append(F.col(f"`{section}`"))
    value = lambda own: F.coalesce(*own)
    return out.select("path", "line_number", "kind", trim_all(F.coalesce("test", "article")).alias("title"), *(F.when(F.upper(trim_all(value(own))) != "NOT NEEDED", value(own)).alias(n) for n, own in columns.items()))


def options(raw: Column) -> Column:
    """A map of options: a JSON object, or k=v entries split at commas and line ends."""
    entries = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,\n]"), trim_all), lambda x: x != "")
    flat = F.map_from_entries(F.transform(F.array_distinct(entries), lambda x: F.struct(trim_all(F.split_part(x, F.lit("="), F.lit(1))).alias("key"), F.when(F.instr(x, "=") > 0, trim_all(F.substring(x, F.instr(x, "=") + 1, F.char_length(x)))).otherwise("").alias("value"))))
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "map<string,string>")).otherwise(flat)


def mode_of(raw: Column, has_html: Column, has_edit: Column) -> Column:
    """How a case is run: wt2html, selser or skip; options in JSON and none at all stand for wt2html."""
    asked = F.when(F.ltrim(raw).startswith("{"), "wt2html").otherwise(F.coalesce(F.try_element_at(options(raw), F.lit("parsoid")), F.lit("wt2html")))
    listed = F.transform(F.split(asked, ","), trim_all)
    return F.when(F.array_contains(listed, "wt2html") & has_html, "wt2html").when(has_edit, "selser").otherwise("skip")


def result_line(status: Column, detail: Column) -> Column:
    return F.when(status == "PASS", "PASS").otherwise(F.concat(status, F.lit(" ("), F.coalesce(detail, F.lit("")), F.lit(")")))


def summary_line() -> Column:
    """The counts of a row of summary() as four lines."""
    shape = "Results: %d/%d passed\n  Failed:  %d\n  Skipped: %d\n  Errors:  %d"
    return F.format_string(shape, "passed", "total", "failed", "skipped", "errors")


def normalized(page: Column) -> Column:
    return trim_all(F.regexp_replace(normalize_paragraphs(strip_annotations(strip_transclusion_spans(body_of(page)))), r">\s+<", "><"))


def run_cases(rows: DataFrame) -> DataFrame:
    """path, line_number, title, mode, status, expected, actual, hint of every test.

    Edits by script (selser) need a browser's tree and are skipped, as are cases without HTML.
    """
    tests = rows.where("kind = 'test'").withColumn("doc_id", F.concat_ws("#", "path", F.col("line_number").cast("string")))
    made = wt2html(tests, text="wikitext")
    expected = F.coalesce("html_parsoid", "html_integrated", "html_php")
    both = tests.join(made, "doc_id", "left").withColumn("expected", normalized(expected)).withColumn("actual", normalized(F.col("html")))
    mode = mode_of(F.col("options_raw"), F.col("expected").isNotNull(), F.col("wikitext_edited").isNotNull())
    both = both.withColumn("mode", mode)
    skip = F.col("wikitext").isNull() | F.col("expected").isNull() | (F.col("mode") != "wt2html")
    status = F.when(skip, "SKIP").when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL")
    return both.select("path", "line_number", "title", "mode", status.alias("status"), "expected", "actual", F.when(~skip, difference_hint(F.col("expected"), F.col("actual"))).alias("hint"))


def summary(results: DataFrame) -> DataFrame:
    """Counts by file, and over all files in the row without a path."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"), ("ERROR", "errors"))]
    return results.rollup("path").agg(F.count(F.lit(1)).alias("total"), *counts)
