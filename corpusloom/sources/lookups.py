"""Keyed content sources as tables and joins: pages, templates, modules, files, redirects, messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import full_text, parse_title, redirect_target, with_prefix

TTL_SECONDS = 300


@dataclass(frozen=True)
class Content:
    """The tables of one wiki: (title, content) each, redirects (src, dst), messages (lang, key, value)."""

    pages: DataFrame
    templates: DataFrame
    modules: DataFrame
    files: DataFrame
    redirects: DataFrame
    messages: DataFrame


def in_memory(spark: SparkSession, pages=(), templates=(), modules=(), files=(), redirects=(), messages=()) -> Content:
    two = "title string, content string"
    return Content(
        spark.createDataFrame(list(pages), two), spark.createDataFrame(list(templates), two), spark.createDataFrame(list(modules), two),
        spark.createDataFrame(list(files), "title string, mime_type string, size bigint, width int, height int, description_url string, file_url string, thumb_urls map<string,string>"),
        spark.createDataFrame(list(redirects), "src string, dst string"), spark.createDataFrame(list(messages), "lang string, key string, value string"),
    )


def page_content(wanted: DataFrame, content: Content) -> DataFrame:
    """wanted (title) with content: from pages, else from templates, else null."""
    p = content.pages.select("title", F.col("content").alias("from_page"))
    t = content.templates.select("title", F.col("content").alias("from_template"))
    return wanted.join(p, "title", "left").join(t, "title", "left").withColumn("content", F.coalesce("from_page", "from_template")).drop("from_page", "from_template")


def resolved(wanted: DataFrame, content: Content) -> DataFrame:
    """wanted (title) with target: where a redirect leads, in one step, else null."""
    return wanted.join(content.redirects.select(F.col("src").alias("title"), F.col("dst").alias("target")), "title", "left")


def messages(wanted: DataFrame, content: Content) -> DataFrame:
    """wanted (lang, key) with value; a missing message gives its key."""
    return wanted.join(content.messages, ["lang", "key"], "left").withColumn("value", F.coalesce("value", "key"))


def prefixed_lookup(wanted: DataFrame, pages: DataFrame, prefix: str, ns: int, name: str = "name") -> DataFrame:
    """wanted with content: the page of that name in the namespace, whether the name carries its prefix or not."""
    title = parse_title(F.col(name))
    full = F.when(title["ns"] == ns, full_text(title)).otherwise(F.concat(F.lit(prefix + ":"), title["text"]))
    known = pages.select(F.col("title").alias("l_title"), "content")
    return wanted.join(known, full == F.col("l_title"), "left").drop("l_title")


def modules(wanted: DataFrame, content: Content, name: str = "name") -> DataFrame:
    """wanted (name) with content: the source of the module, null for a missing one."""
    return prefixed_lookup(wanted, content.modules, "Module", 828, name)


def files(wanted: DataFrame, content: Content) -> DataFrame:
    """wanted (title) with file, the facts of the file as a struct, null for a missing one."""
    facts = [c for c in content.files.columns if c != "title"]
    known = content.files.select(F.col("title").alias("l_title"), F.struct(*facts).alias("file"))
    return wanted.join(known, F.col("title") == F.col("l_title"), "left").drop("l_title")


def page_messages(wanted: DataFrame, content: Content) -> DataFrame:
    """wanted (key) with value: the text of the page MediaWiki:key, for a wiki without a message table."""
    known = content.pages.select(F.col("title").alias("l_title"), F.col("content").alias("value"))
    found = wanted.join(known, F.concat(F.lit("MediaWiki:"), "key") == F.col("l_title"), "left").drop("l_title")
    return found.withColumn("value", F.coalesce("value", "key"))


def fresh(rows: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, fetched: str = "fetched_at") -> DataFrame:
    """Cached rows that are younger than the time to live; 0 keeps none."""
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(fetched).cast("timestamp")) < ttl_seconds)


def module_title(name: Column) -> Column:
    return with_prefix(name, "Module")


def template_title(name: Column) -> Column:
    return with_prefix(name, "Template")


def redirects_of(pages: DataFrame) -> DataFrame:
    """src, dst of the pages whose text is a redirect."""
    return pages.select(F.col("title").alias("src"), redirect_target(F.col("content")).alias("dst")).where("dst is not null")


# ---------------------------------------------------------------- API payloads and dumps

_REVISION = "query struct<pages:array<struct<title:string,missing:boolean,revisions:array<struct<slots:struct<main:struct<content:string>>,content:string>>,imageinfo:array<struct<url:string,descriptionurl:string,mime:string,size:bigint,width:int,height:int>>>>>"


def page_from_payload(payload: Column) -> Column:
    """The text of the first revision in a query answer (format version 2), else null."""
    page = F.get(F.from_json(payload, _REVISION)["query"]["pages"], 0)
    revision = F.get(page["revisions"], 0)
    return F.coalesce(revision["slots"]["main"]["content"], revision["content"])


def file_from_payload(payload: Column) -> Column:
    page = F.get(F.from_json(payload, _REVISION)["query"]["pages"], 0)
    info = F.get(page["imageinfo"], 0)
    return F.struct(page["title"].alias("title"), info["mime"].alias("mime_type"), info["size"].alias("size"), info["width"].alias("width"), info["height"].alias("height"), info["descriptionurl"].alias("description_url"), info["url"].alias("file_url"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, content of an XML page dump, read by Spark's own XML source, split by page."""
    schema = "title string, ns int, revision struct<text:string>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", "ns", F.col("revision.text").alias("content"))
