"""Page titles and link targets as native struct expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .site import INTERWIKI, MAGIC_WORDS, NAMESPACES
from .text import trim_all


def _map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def _prefixes() -> Column:
    names = [(name, i) for i, name, _ in NAMESPACES if i] + [(a, i) for i, _, also in NAMESPACES for a in also]
    return _map((n.lower(), i) for n, i in names)


def namespace_prefix(ns: Column) -> Column:
    return F.coalesce(F.try_element_at(_map((i, name) for i, name, _ in NAMESPACES if i), ns.cast("int")), F.lit(""))


def parse_title(text: Column) -> Column:
    """(interwiki, ns, text, fragment): fragment after the first #, a leading colon forces namespace 0,
    then an interwiki prefix, then a namespace name or alias."""
    whole = trim_all(text)
    cut = F.instr(whole, "#")
    fragment = F.when(cut > 0, F.substring(whole, cut + 1, F.char_length(whole)))
    bare = F.when(cut > 0, F.substring(whole, F.lit(1), cut - 1)).otherwise(whole)
    colon = F.instr(bare, ":")
    prefix, rest = F.substring(bare, F.lit(1), colon - 1), F.substring(bare, colon + 1, F.char_length(bare))
    wiki = F.when((colon > 1) & prefix.isin([p for p, _ in INTERWIKI]), prefix)
    ns = F.when(colon > 1, F.try_element_at(_prefixes(), F.lower(trim_all(prefix))))
    return F.struct(
        wiki.alias("interwiki"),
        F.when(wiki.isNotNull(), 0).otherwise(F.coalesce(ns, F.lit(0))).alias("ns"),
        trim_all(F.when((colon == 1) | wiki.isNotNull() | ns.isNotNull(), rest).otherwise(bare)).alias("text"),
        fragment.alias("fragment"),
    )


def full_text(title: Column) -> Column:
    prefix = namespace_prefix(title["ns"])
    return F.when(prefix == "", title["text"]).otherwise(F.concat(prefix, F.lit(":"), title["text"]))


def display_title(title: Column) -> Column:
    start = F.coalesce(F.concat(title["interwiki"], F.lit(":")), F.lit(""))
    return F.concat(start, full_text(title), F.coalesce(F.concat(F.lit("#"), title["fragment"]), F.lit("")))


def template_title(name: Column) -> Column:
    """The title of a template: its own namespace if it names one, else 10."""
    title = parse_title(name)
    return F.struct(title["interwiki"].alias("interwiki"), F.when(title["ns"] == 0, 10).otherwise(title["ns"]).alias("ns"), title["text"].alias("text"), title["fragment"].alias("fragment"))


def title_facts(title: Column) -> Column:
    return F.struct(
        title["text"].alias("text"), namespace_prefix(title["ns"]).alias("ns_text"), title["ns"].alias("namespace"), full_text(title).alias("full_text"),
        F.coalesce(title["fragment"], F.lit("")).alias("fragment"), F.split_part(title["text"], F.lit("/"), F.lit(1)).alias("root_text"), F.lit(False).alias("exists"), F.lit(False).alias("is_redirect"),
    )


def with_current_title(docs: DataFrame, title: str = "title") -> DataFrame:
    """docs with page, the facts of the title that each row is the page of."""
    return docs.withColumn("page", title_facts(parse_title(F.col(title))))


def with_prefix(name: Column, prefix: str) -> Column:
    return F.when(F.instr(name, ":") == 0, F.concat(F.lit(prefix + ":"), name)).otherwise(name)


def parse_wikilink(text: Column) -> Column:
    """[[target|display]] without its brackets: title and display (the target without one)."""
    target = F.split_part(text, F.lit("|"), F.lit(1))
    shown = F.when(F.instr(text, "|") > 0, F.substring(text, F.instr(text, "|") + 1, F.char_length(text)))
    return F.struct(parse_title(target).alias("title"), F.coalesce(shown, trim_all(target)).alias("display"))


def parse_extlink(url: Column, text: Column) -> Column:
    return F.struct(trim_all(url).alias("url"), F.nullif(text, F.lit("")).alias("text"))


def redirect_target(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), r"(?is)^#redirect.*?\[\[(.*?)\]\]", 1), F.lit(""))


def magic_word(alias: Column) -> Column:
    """The canonical name of a magic word, by any of its spellings in either case, else null."""
    return F.try_element_at(_map((a.lower(), k) for k, v in MAGIC_WORDS.items() for a in v), F.lower(alias))


def wikilink_html(target: Column, display: Column | None = None) -> Column:
    from .text import attr_escape, html_escape, title_to_url

    shown = F.coalesce(F.nullif(display, F.lit("")), F.regexp_replace(target, "^[^:]*:", "")) if display is not None else F.regexp_replace(target, "^[^:]*:", "")
    return F.concat(F.lit('<a rel="mw:WikiLink" href="./'), title_to_url(target), F.lit('" title="'), attr_escape(target), F.lit('">'), html_escape(shown), F.lit("</a>"))


def extlink_html(url: Column, display: Column) -> Column:
    from .text import html_escape

    return F.concat(F.lit('<a rel="mw:ExtLink" href="'), url, F.lit('">'), html_escape(F.coalesce(F.nullif(display, F.lit("")), F.concat(F.lit("["), url, F.lit("]")))), F.lit("</a>"))


def wikilink_markup(href: Column, display: Column) -> Column:
    return F.concat(F.lit("[["), href, F.when(display == href, "").otherwise(F.concat(F.lit("|"), display)), F.lit("]]"))


def extlink_markup(href: Column, display: Column) -> Column:
    return F.concat(F.lit("["), href, F.when(display == F.concat(F.lit("["), href, F.lit("]")), "").otherwise(F.concat(F.lit(" "), display)), F.lit("]"))
