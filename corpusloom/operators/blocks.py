"""Wiki markup to HTML as a relational plan: lines, line kinds, islands of lines, blocks, pages.

A page is laid out as line rows. Windows over a page's lines find islands (paragraphs, lists,
tables, preformatted text); two aggregations on the page's own key put blocks and pages together,
so a page's rows are shuffled once. Inline markup is native string expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.braces import BEGIN, END, MARK, OWN, calls_held, guarded, released
from ..functions.site import PARAGRAPH_BREAKING_TAGS
from ..functions.text import comment_escape, html_document, let, replaced, spliced
from ..functions.titles import extlink_html, wikilink_html
from .rows import ROW, by_row, names_of, numbered
from .tokens import inline_quotes

_BLOCK_LINE = r"(?i)^\s*</?(?:" + "|".join(PARAGRAPH_BREAKING_TAGS) + r")\b"
#: Signs that are to be read as they are, and what stands for them between the steps.
_SIGNS = tuple((sign, f"{MARK}{n}") for n, sign in enumerate("'[]", 1))
_TAG = r"</?[A-Za-z][A-Za-z0-9-]*+(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def _text_escaped(line: Column) -> Column:
    """Escapes & and the < signs that do not begin a tag or comment."""
    return F.regexp_replace(F.replace(line, F.lit("&"), F.lit("&amp;")), rf"<(?!{_TAG[1:]}|!--)", "&lt;")


def inline_html(line: Column) -> Column:
    """Links, quotes, nowiki, comments and escapes of one line."""
    line = _text_escaped(guarded(line))
    literal = lambda m: replaced(F.regexp_replace(m, "^<nowiki>|</nowiki>$", ""), ("<", "&lt;"), *_SIGNS)
    line = spliced(line, r"(?s)<nowiki>.*?</nowiki>", literal)
    line = F.regexp_replace(line, r"<nowiki\s*/>", "")
    line = spliced(line, r"(?s)<!--.*?-->", lambda m: F.concat(F.lit("<!--"), comment_escape(F.regexp_replace(F.replace(m, F.lit("&amp;"), F.lit("&")), "^<!--|-->$", "")), F.lit("-->")))

    def wiki(m: Column) -> Column:
        return let(F.regexp_replace(m, r"^\[\[|\]\]$", ""), _wiki_html)

    def _wiki_html(inner: Column) -> Column:
        bar = F.instr(inner, "|")
        shown = F.when(bar > 0, F.substring(inner, bar + 1, F.char_length(inner)))
        return F.replace(wikilink_html(F.split_part(inner, F.lit("|"), F.lit(1)), F.coalesce(F.replace(shown, F.lit("&amp;"), F.lit("&")), F.lit(""))), F.lit("&amp;amp;"), F.lit("&amp;"))

    def external(m: Column) -> Column:
        return let(F.regexp_replace(m, r"^\[|\]$", ""), _external_html)

    def _external_html(inner: Column) -> Column:
        cut = F.instr(inner, " ")
        url = F.when(cut > 0, F.substring(inner, F.lit(1), cut - 1)).otherwise(inner)
        return extlink_html(url, F.when(cut > 0, F.replace(F.substring(inner, cut + 1, F.char_length(inner)), F.lit("&amp;"), F.lit("&"))))

    line = spliced(line, r"\[\[[^\[\]\n]+\]\]", wiki)
    line = spliced(line, r"\[(?:https?://|ftp://|mailto:|//)[^\]\n]*\]", external)
    line = F.regexp_replace(line, r"__([A-Za-z]+)__", "[__$1__]")
    line = F.regexp_replace(let(line, inline_quotes), r"(?i)<br\s*/?>", "<br/>")
    return F.when(F.contains(line, F.lit(MARK)), replaced(line, *((held, sign) for sign, held in _SIGNS), (OWN, MARK))).otherwise(line)


def markup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """loom_row, key, line, s, kind, level: the lines of each input row and what they are."""
    rows = numbered(docs, key, F.coalesce(text, F.lit("")).alias("s"))
    rows = rows.select(*by_row(key), F.posexplode(F.split("s", "\n", -1)).alias("line", "s"))
    s = F.col("s")
    w = Window.partitionBy(ROW).orderBy("line")
    opened = F.sum(F.when(s.rlike(r"(?i)^\s*<pre\b"), 1).otherwise(0) - F.when(s.rlike(r"(?i)</pre\s*>"), 1).otherwise(0)).over(w)
    in_pre = (opened > 0) | s.rlike(r"(?i)</pre\s*>")
    table = F.sum(F.when(s.startswith("{|"), 1).otherwise(0)).over(w) > F.sum(F.when(s.startswith("|}"), 1).otherwise(0)).over(w)
    kind = (
        F.when(in_pre, "pre").when(table | s.startswith("|}"), "table")
        .when(s.rlike(r"^={2,6}[^=].*?={2,6}[ \t]*$") | s.rlike(r"^={2,6} \S"), "heading").when(s.rlike(r"^-{4,}"), "rule")
        .when(s.rlike(r"^[*#;:]"), F.when(s.startswith("#"), "ol").when(s.startswith("*"), "ul").otherwise("dl"))
        .when(s.rlike(r"^\s*$"), "blank").when(s.rlike(r"(?s)^\s*<!--.*-->\s*$"), "comment").when(s.rlike(_BLOCK_LINE), "html").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    return rows.withColumn("level", F.when(F.col("kind") == "heading", F.char_length(F.regexp_extract("s", "^(=+)", 1))).when(F.col("kind").isin("ol", "ul", "dl"), F.char_length(F.regexp_extract("s", r"^([*#;:]+)", 1))))


def _islands(rows: DataFrame) -> DataFrame:
    """Adds block: headings, rules, comments and HTML lines stand alone, other neighbours of one kind join."""
    w = Window.partitionBy(ROW).orderBy("line")
    fresh = F.col("kind").isin("heading", "rule", "comment", "html") | (F.col("kind") == "table") & F.col("s").startswith("{|")
    new = F.coalesce(fresh | (F.col("kind") != F.lag("kind").over(w)), F.lit(True)).cast("int")
    return rows.withColumn("new", new).withColumn("block", F.sum("new").over(w)).drop("new")


def _rendered(rows: DataFrame) -> DataFrame:
    """Adds out, the HTML of each line within its block. Inline markup is rendered in one place only."""
    kind, s = F.col("kind"), F.col("s")
    rest = lambda n: F.substring(s, n, 1 << 30)
    parts = (
        F.when(kind == "heading", F.array(F.trim(F.regexp_replace(F.regexp_replace(s, r"^={2,6}", ""), r"=+[ \t]*$", ""))))
        .when(kind.isin("ol", "ul", "dl"), F.array(F.ltrim(F.regexp_replace(s, r"^[*#;:]+", ""))))
        .when((kind == "table") & s.startswith("|+"), F.array(F.trim(rest(3)))).when((kind == "table") & s.rlike(r"^(?:\{\||\|\}|\|-)"), F.array().cast("array<string>"))
        .when((kind == "table") & s.rlike(r"^[|!]"), F.transform(F.split(rest(2), r"\|\||!!", -1), lambda x: F.trim(x))).when(kind.isin("pre", "rule", "blank"), F.array().cast("array<string>")).otherwise(F.array(s))
    )
    rows = rows.withColumn("parts", parts).withColumn("parts", F.transform("parts", inline_html))
    one, level = F.get("parts", F.lit(0)), F.col("level").cast("string")
    cell = F.when(s.startswith("!"), "th").otherwise("td")
    item = F.when(kind != "dl", "li").when(s.startswith(";"), "dt").otherwise("dd")
    wrap = lambda tag, x: F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">"))
    out = (
        F.when(kind == "heading", wrap(F.concat(F.lit("h"), level), one)).when(kind == "rule", "<hr/>").when(kind.isin("ol", "ul", "dl"), wrap(item, one)).when(kind == "pre", s)
        .when((kind == "table") & s.startswith("{|"), F.concat(F.lit("<table"), F.when(F.trim(rest(3)) == "", "").otherwise(F.concat(F.lit(" "), F.trim(rest(3)))), F.lit(">")))
        .when((kind == "table") & s.startswith("|}"), "").when((kind == "table") & s.startswith("|-"), "</tr><tr>").when((kind == "table") & s.startswith("|+"), wrap(F.lit("caption"), one))
        .when((kind == "table") & s.rlike(r"^[|!]"), F.array_join(F.transform("parts", lambda x: wrap(cell, x)), "")).otherwise(one)
    )
    return rows.withColumn("out", out)


def _block_html(kind: Column, lines: Column) -> Column:
    table = F.regexp_replace(F.array_join(lines, ""), r"(?s)^(<table[^>]*>(?:<caption>.*?</caption>)?)", "$1<tr>")
    return (
        F.when(kind.isin("ol", "ul", "dl"), F.concat(F.lit("<"), kind, F.lit(">"), F.array_join(lines, "\n"), F.lit("</"), kind, F.lit(">")))
        .when(kind == "table", F.replace(F.concat(table, F.lit("</tr></table>")), F.lit("<tr></tr>"), F.lit("")))
        .when(kind == "text", F.concat(F.lit("<p>"), F.array_join(lines, "\n"), F.lit("</p>"))).when(kind != "blank", F.array_join(lines, "\n"))
    )


def without_calls(text: Column) -> Column:
    """The text without its templates, functions and arguments, which mean nothing before they are expanded."""
    return released(F.regexp_replace(calls_held(text), rf"(?s){BEGIN}.*?{END}", ""))


def wt2html(docs: DataFrame, key: str = "doc_id", text: str = "text", body_only: bool = True, language: str = "en", unexpanded: str = "keep") -> DataFrame:
    """key, html: each row's markup as HTML; an empty text gives an empty body.

    unexpanded: ``drop`` leaves calls out that nobody has expanded, ``keep`` shows them as text.

    Rows: every input row gives one row, whether its key is null or repeated; a null text is empty;
    other columns are left out.
    """
    names = names_of(docs, key)
    if unexpanded == "drop":
        docs = numbered(docs, key, without_calls(F.col(text)).alias(text))
    rows = _rendered(_islands(markup_lines(docs, key, text)))
    blocks = rows.groupBy(*by_row(key), "block").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("line", "out"))).alias("lines"))
    blocks = blocks.select(*by_row(key), "block", _block_html(F.col("kind"), F.transform("lines", lambda x: x["out"])).alias("html"))
    pages = blocks.groupBy(*by_row(key)).agg(F.array_sort(F.collect_list(F.when(F.col("html").isNotNull(), F.struct("block", "html")))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x["html"]), "\n")
    return pages.select(*names, html_document(body, F.lit(language), body_only).alias("html"))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = markup_lines(docs, key, text).where("kind = 'heading'")
    return rows.select(key, "line", "level", F.trim(F.regexp_replace(F.expr("substring(s, level + 1)"), r"=+[ \t]*$", "")).alias("title"))


def wikilinks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, target, display of every [[target|display]]."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    rows = docs.select(key, F.posexplode(found).alias("ord", "inner"))
    return rows.select(key, "ord", F.trim(F.split_part("inner", F.lit("|"), F.lit(1))).alias("target"), F.coalesce(F.when(F.instr("inner", "|") > 0, F.expr("substring(inner, instr(inner, '|') + 1)")), F.col("inner")).alias("display"))


def extlinks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(text, F.lit(r"(?<!\[)\[((?:https?://|ftp://|mailto:|//)[^\]\n]*)\]"), F.lit(1))
    rows = docs.select(key, F.posexplode(found).alias("ord", "inner"))
    return rows.select(key, "ord", F.split_part("inner", F.lit(" "), F.lit(1)).alias("url"), F.when(F.instr("inner", " ") > 0, F.expr("substring(inner, instr(inner, ' ') + 1)")).alias("display"))


def template_refs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name of every {{name...}}, at any depth; functions and arguments left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\{)\{\{(?!\{)\s*([^{}|#][^{}|]*)"), F.lit(1))
    return docs.select(key, F.explode(found).alias("name")).select(key, F.trim("name").alias("name"))
