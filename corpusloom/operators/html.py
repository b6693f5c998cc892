"""HTML pages as rows: tags, comments, links, nodes; and nodes as wiki markup or HTML again."""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.braces import MARK, guarded
from ..functions.site import BLOCK_TAGS, KIND_TAGS, TAG_KINDS
from ..functions.templates import extension_markup, template_markup
from ..functions.text import body_of, comment_escape, get_attr, html_escape, let, node_attributes, replaced, text_decode, trim_all
from .rows import ROW, by_row, names_of, numbered, spread
from .tokens import parse_attributes

# Loops are possessive, so that they need no stack however long a tag is.
_ATTRS = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_RAW = "script|style|title|textarea"
PIECE = rf"(?s)<!--.*?-->|<(?i:{_RAW})\b{_ATTRS}>.*?</(?i:{_RAW})\s*>|</?[A-Za-z]{_ATTRS}>|<![^>]*>|[^<]+|<"
VOID = "area base br col embed hr img input link meta source track wbr".split()


def _pieces(page: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(PIECE), F.lit(0))


def _tag_of(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))


def _attributes_of(piece: Column) -> Column:
    return parse_attributes(F.regexp_extract(piece, rf"(?s)^(<[A-Za-z]{_ATTRS}>)", 1))


def _plain_kind(tag: Column) -> Column:
    """The kind of an element without attributes."""
    plain = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TAG_KINDS.items())), tag)
    return F.when(tag == "a", "Span").when(tag.rlike("^h[1-6]$"), "Heading").otherwise(F.coalesce(plain, F.lit("Other")))


def element_kind(tag: Column, attrs: Column) -> Column:
    """The kind of an element: typeof first, then rel, then href rules for a, then the tag."""
    types = F.split(F.coalesce(get_attr(attrs, "typeof"), F.lit("")), r"\s+")
    rel = get_attr(attrs, "rel")
    return (
        F.when(F.array_contains(types, "mw:Transclusion"), "Transclusion")
        .when(F.exists(types, lambda t: t.startswith("mw:Extension/")), "ExtensionTag")
        .when(F.exists(types, lambda t: t.startswith("mw:Annotation/")), "Annotation")
        .when(rel == "mw:PageProp/Category", "CategoryLink")
        .when(rel == "mw:WikiLink/Interwiki", "Wikilink")
        .when((tag == "a") & (rel == "mw:ExtLink"), "ExtLink")
        .when((tag == "a") & get_attr(attrs, "href").isNotNull(), "Wikilink")
        .otherwise(_plain_kind(tag))
    )


def kind_tag(kind: Column, level: Column, tag: Column) -> Column:
    """The tag that an element of the kind is written as."""
    plain = F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in KIND_TAGS.items())), kind)
    return F.when(kind == "Heading", F.concat(F.lit("h"), F.when(level.between(1, 6), level).otherwise(2).cast("string"))).when(kind == "Other", tag).otherwise(plain)


def html_tags(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, tag, closing, attrs, elem_kind, level: a row for each tag outside comments and raw text."""
    rows = pages.select(key, F.posexplode(_pieces(F.col(html))).alias("ord", "piece")).where(F.col("piece").rlike("^</?[A-Za-z]"))
    closing = F.col("piece").startswith("</")
    rows = rows.select(key, "ord", _tag_of(F.col("piece")).alias("tag"), closing.alias("closing"), F.when(~closing, _attributes_of(F.col("piece"))).alias("attrs"))
    rows = rows.withColumn("elem_kind", element_kind(F.col("tag"), F.col("attrs")))
    return rows.withColumn("level", F.when(F.col("elem_kind") == "Heading", F.substring("tag", 2, 1).cast("int")))


def html_comments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)(?:-->|\z)"), F.lit(1))).alias("ord", "comment"))


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ord, href: links in page order, numbered from 0. Found and numbered within the row: no shuffle."""
    links = F.filter(_pieces(F.col(html)), lambda p: p.rlike(r"^<[aA][\s/>]"))
    hrefs = F.filter(F.transform(links, lambda p: get_attr(_attributes_of(p), "href")), lambda h: h.isNotNull())
    return pages.select(key, F.posexplode(hrefs).alias("ord", "href"))


def html_title(page: Column) -> Column:
    return trim_all(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


# ---------------------------------------------------------------- nodes

_PLACE = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("parent", "ord", "depth", "until")]
        + [T.StructField(n, T.StringType()) for n in ("path", "above", "text")]
    )
)


#: Open elements that the start of an element ends, and the elements beyond which it does not look.
_CELLS, _LISTS = ("td", "th"), ("ul", "ol", "dl", "table")
_ENDS = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), _LISTS), "dd": (("dt", "dd"), _LISTS), "option": (("option",), ("select",)),
    "td": (_CELLS, ("table",)), "th": (_CELLS, ("table",)), "tr": (("tr", *_CELLS), ("table",)),
}


def _place(steps: list[str] | None, columns: list[list]) -> None:
    """Adds the places of one page's steps to the columns: '+tag mark' opens, '-tag' closes, '.text' and '!tag mark' are leaves."""
    parents, ords, depths, untils, paths, aboves, texts = columns
    first, open_nodes, children = len(untils), [(-1, "", "", "")], {-1: 0}
    open_tags: dict[str, int] = {}

    def close() -> str:
        node, tag, _, _ = open_nodes.pop()
        open_tags[tag] -= 1
        untils[first + node] = len(untils) - first
        return tag

    for step in steps if steps is not None else ():
        sign, (tag, _, mark) = step[0], ("", "", "") if step[0] == "." else step[1:].partition(" ")
        if sign == "-":
            while open_tags.get(tag) and close() != tag:
                pass
            for column in columns:
                column.append(None)
            continue
        if sign == "+" and tag in BLOCK_TAGS and open_nodes[-1][1] == "p":
            close()
        ended, scope = _ENDS.get(tag, ((), ()))
        if any(open_tags.get(name) for name in ended):
            last, at = 0, len(open_nodes) - 1
            while at and open_nodes[at][1] not in scope:
                last, at = at if open_nodes[at][1] in ended else last, at - 1
            while last and len(open_nodes) > last:
                close()
        parent, _, path, above = open_nodes[-1]
        nth = children.get(parent, 0)
        children[parent] = nth + 1
        own = f"{path}/{nth:05d}"
        text = entities.unescape(step[1:]) if sign == "." and len(step) > 1 else None
        at = len(untils) - first
        for column, value in zip(columns, (parent, nth, len(open_nodes), at, own, above, text)):
            column.append(value)
        if sign == "+":
            open_nodes.append((at, tag, own, above + mark))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(open_nodes) > 1:
        close()


#: Pieces of pages that are Python objects at a time; the rest of a batch stays in Arrow.
PIECES = 20_000
_COLUMNS = pa.struct([*((n, pa.int32()) for n in ("parent", "ord", "depth", "until")), *((n, pa.string()) for n in ("path", "above", "text"))])


def _arrays(rows: pa.Array) -> Iterator[pa.Array]:
    """The places of the rows, in as many arrays as it takes to hold few objects at a time."""
    sizes = rows.value_lengths().fill_null(0).to_pylist()
    begin = 0
    while begin < len(rows):
        end, held = begin + 1, sizes[begin]
        while end < len(rows) and held + sizes[end] <= PIECES:
            held, end = held + sizes[end], end + 1
        columns: list[list] = [[] for _ in range(_COLUMNS.num_fields)]
        ends = [0]
        for steps in rows.slice(begin, end - begin).to_pylist():
            _place(steps, columns)
            ends.append(len(columns[0]))
        values = [pa.array(c, f.type) for c, f in zip(columns, _COLUMNS)]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=list(_COLUMNS), mask=values[0].is_null()))
        begin = end


@F.arrow_udf(_PLACE)
def _placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in batches:
        yield pa.concat_arrays([pa.array([], pa.list_(_COLUMNS)), *_arrays(rows)])


#: How a kind bears on the markup of what lies below it.
_MARKS = {"UnorderedList": "u", "OrderedList": "o", "ListItem": "i", "Wikilink": "a", "ExtLink": "a", "ExtensionTag": "x", "Table": "t", "TableRow": "t", "Preformatted": "p"}


_TAG_MARKS = {"ul": "u", "ol": "o", "li": "i", "table": "t", "tr": "t", "pre": "p"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def _every_of(piece: Column) -> Column:
    """The attributes of an element's tag, with their references read."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    some = F.transform(_attributes_of(piece), lambda a: F.struct(a["k"].alias("k"), text_decode(a["v"]).alias("v")))
    return F.when(piece.rlike(r"^<[A-Za-z][^\s>]*>$"), none).when(piece.rlike("^<[A-Za-z]"), some)


def _mark(tag: Column, piece: Column) -> Column:
    """The mark of an element; attributes are only read where they can decide."""

    def of_kind(every: Column) -> Column:
        kind = element_kind(tag, every)
        rebuilt = (kind == "Transclusion") & (F.coalesce(template_markup(get_attr(every, "data-mw")), F.lit("")) != "")
        return F.when(rebuilt, "x").otherwise(F.coalesce(F.try_element_at(_map(_MARKS), kind), F.lit("-")))

    plain = F.when((tag == "a") & piece.rlike(r"(?i)\shref\s*="), "a").otherwise(F.coalesce(F.try_element_at(_map(_TAG_MARKS), tag), F.lit("-")))
    return F.when(piece.rlike(r"(?i)\s(?:typeof|rel)\s*="), of_kind(_every_of(piece))).otherwise(plain)


def _step(piece: Column) -> Column:
    leaf = piece.endswith("/>") | piece.rlike(rf"(?i)^<(?:{_RAW})\b")
    opened = lambda tag: F.concat(F.when(leaf | tag.isin(VOID), "!").otherwise("+"), tag, F.lit(" "), _mark(tag, piece))
    text = F.when(F.contains(piece, F.lit("&")) & ~piece.startswith("<!--"), piece).otherwise("")
    return F.when(piece.startswith("</"), F.concat(F.lit("-"), _tag_of(piece))).when(piece.rlike("^<[A-Za-z]"), opened(_tag_of(piece))).otherwise(F.concat(F.lit("."), text))


def _found(page: Column) -> Column:
    return F.filter(_pieces(body_of(page)), lambda p: ~p.rlike(r"^<[!?](?!--)"))


def _node(piece: Column, p: Column, i: Column, every: Column, tag: Column, kind: Column, read_text: Callable[[Column], Column] | None = None) -> list[Column]:
    """The columns of a node of a piece at place p; read_text gives the text of a piece of text, in place of the one with every reference read."""
    is_element, is_comment = piece.rlike("^<[A-Za-z]"), piece.startswith("<!--")
    own = read_text(piece) if read_text else F.coalesce(p["text"], piece)
    text = F.when(is_comment, F.regexp_replace(piece, "(?s)^<!--|-->$", "")).when(~is_element, own)
    return [
        i.alias("node_id"), p["parent"].alias("parent_id"), p["ord"].alias("ord"), p["depth"].alias("depth"), p["path"].alias("path"), p["until"].alias("until"),
        F.when(is_comment, "Comment").when(is_element, "Element").otherwise("Text").alias("node_kind"), kind.alias("elem_kind"),
        F.when(kind == "Heading", F.substring(tag, 2, 1).cast("int")).alias("level"), tag.alias("tag"), text.alias("text"),
        F.filter(every, lambda a: ~a["k"].isin("data-parsoid", "data-mw")).alias("attrs"), get_attr(every, "data-parsoid").alias("data_parsoid"),
        get_attr(every, "data-mw").alias("data_mw"), p["above"].alias("above"),
    ]


def _kind_of(tag: Column, every: Column) -> Column:
    return F.when(tag.isNotNull(), F.when(F.size(every) == 0, _plain_kind(tag)).otherwise(element_kind(tag, every)))


def _own_tag(piece: Column) -> Column:
    return F.when(piece.rlike("^<[A-Za-z]"), _tag_of(piece))


def _nodes(found: Column, places: Column, read_text: Callable[[Column], Column] | None = None) -> Column:
    """The array of nodes of the pieces at their places."""
    both = F.transform(F.arrays_zip(found.alias("n"), places.alias("p")), lambda x, i: F.struct(x["n"].alias("n"), x["p"].alias("p"), i.alias("i")))
    named = lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p"), x["i"].alias("i"), _own_tag(x["n"]).alias("tag"), _every_of(x["n"]).alias("every"))
    whole = lambda x: let(_kind_of(x["tag"], x["every"]), lambda kind: F.struct(*_node(x["n"], x["p"], x["i"], x["every"], x["tag"], kind, read_text)))
    return F.transform(F.transform(F.filter(both, lambda x: x["p"].isNotNull()), named), whole)


def with_nodes(pages: DataFrame, page: Column, name: str, read_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages with one more column: an array of the nodes of page, in page order.

    Texts have every character reference read, as HTML does, those without a semicolon included;
    read_text(piece) reads the pieces of text in another way.
    """
    found, places = f"{name}_found", f"{name}_places"
    pages = pages.withColumn(found, _found(page)).withColumn(places, _placed(F.transform(found, _step)))
    return pages.withColumn(name, _nodes(F.col(found), F.col(places), read_text)).drop(found, places)


def html_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """loom_row, key, node_id, parent_id, ord, depth, path, node_kind, elem_kind, level, tag, text, attrs,
    data_parsoid, data_mw, above, until: the nodes of each page's body in pre-order.

    Recognising and describing nodes is native; only the nesting of tag names and the references in
    texts pass through a small helper. Only the pages shuffle, once, by their number. above has a sign for each element around
    the node: u and o lists, i item, a link, t table or row, p preformatted, x rebuilt from data-mw, - other. until
    is the number of the piece of the page at which the node ends.

    Rows: pages that share a key, or have none, have numbers of their own; null and empty pages have
    no nodes; other columns are left out.
    """
    own = by_row(key)
    rows = spread(numbered(pages, key, F.col(html).alias("html"))).select(*own, _found(F.col("html")).alias("piece"))
    rows = rows.withColumn("place", _placed(F.transform("piece", _step)))
    rows = rows.select(*own, F.posexplode(F.arrays_zip("piece", "place")).alias("i", "x")).select(*own, "i", "x.piece", "x.place").where("place is not null")
    rows = rows.withColumns({"tag": _own_tag(F.col("piece")), "every": _every_of(F.col("piece"))})
    rows = rows.withColumn("kind", _kind_of(F.col("tag"), F.col("every")))
    return rows.select(*own, *_node(*map(F.col, ("piece", "place", "i", "every", "tag", "kind"))))


def wt_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The node table of wiki markup: what html_nodes gives for the page that wt2html makes of each row.

    Calls that nobody has expanded are left out; other rules are those of the two operators.
    """
    from .blocks import wt2html

    return html_nodes(wt2html(numbered(docs, key, text), key, text, unexpanded="drop"), key, "html")


# ---------------------------------------------------------------- nodes to text

#: Begin of a wiki link and of an external link, end of the target, end of the link.
_WIKI, _EXT, _SHOWN, _DONE = (MARK + digit for digit in "1234")


def _pair(before: str | Column, after: str | Column = "") -> Column:
    return F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(n) for n, x in (("before", before), ("after", after))))


def _tagged(tag: Column, attrs: str | Column = "", after: str = "") -> Column:
    return _pair(F.concat(F.lit("<"), tag, F.lit(attrs) if isinstance(attrs, str) else attrs, F.lit(">")), F.concat(F.lit("</"), tag, F.lit(">" + after)))


def _markup_of(n: Column) -> Column:
    """(before, after): the markup before and after what lies below a node."""
    kind, tag, above, is_text = n["elem_kind"], n["tag"], n["above"], n["node_kind"] == "Text"
    own = lambda name: guarded(F.coalesce(get_attr(n["attrs"], name), F.lit("")))
    attr = lambda a: F.concat(F.lit(" "), a["k"], F.when(a["v"] == "", "").otherwise(F.concat(F.lit('="'), a["v"], F.lit('"'))))
    listed = guarded(F.array_join(F.transform(n["attrs"], attr), ""))
    depth, in_list = F.regexp_count(above, F.lit("[uo]")), above.rlike("[uo]$")
    bullet = F.concat(F.when(depth > 1, "\n").otherwise(""), F.repeat(F.when(above.endswith("o"), "#").otherwise("*"), depth), F.lit(" "))
    equals = F.repeat(F.lit("="), n["level"])
    drops_tag = tag.isin("tbody", "thead", "tfoot", *_RAW.split("|"))
    out = (
        F.when(is_text, _pair(guarded(n["text"]))).when(n["node_kind"] == "Comment", _pair(F.concat(F.lit("<!--"), guarded(n["text"]), F.lit("-->"))))
        .when(kind == "Paragraph", _pair("", "\n")).when(kind == "Heading", _pair(equals, F.concat(equals, F.lit("\n"))))
        .when(kind == "Bold", _pair("'''", "'''")).when(kind == "Italic", _pair("''", "''"))
        .when(kind == "Wikilink", _pair(F.concat(F.lit(_WIKI), own("href"), F.lit(_SHOWN)), _DONE))
        .when(kind == "ExtLink", _pair(F.concat(F.lit(_EXT), own("href"), F.lit(_SHOWN)), _DONE))
        .when(kind == "ListItem", F.when(in_list, _pair(bullet, F.when(depth == 1, "\n").otherwise(""))).otherwise(_pair("")))
        .when(kind == "Table", _pair(F.concat(F.lit("{|"), listed, F.lit("\n")), "|}\n")).when(kind == "TableRow", _pair("|-\n"))
        .when(kind == "TableCell", _pair(F.when(tag == "th", "!").otherwise("|"), "\n")).when(kind == "TableCaption", _pair("|+ ", "\n"))
        .when(kind == "Preformatted", _pair("<pre>", "</pre>\n")).when(kind == "HorizontalRule", _pair("----\n")).when(kind == "LineBreak", _pair("<br/>\n"))
        .when(kind == "Div", _tagged(F.lit("div"), listed, "\n")).when(kind == "Span", _tagged(F.lit("span"), listed))
        .when(kind == "Image", _pair(F.concat(F.lit("[["), own("src"), F.lit("]]"))))
        .when(kind == "Transclusion", _pair(guarded(F.coalesce(template_markup(n["data_mw"]), F.lit("")))))
        .when(kind == "ExtensionTag", _pair(guarded(F.coalesce(extension_markup(n["data_mw"]), F.lit("<ext/>")))))
        .when((kind == "Other") & ~drops_tag, F.when(tag.isin(VOID), _pair(F.concat(F.lit("<"), tag, F.lit("/>")))).otherwise(_tagged(tag)))
        .otherwise(_pair(""))
    )
    stray = in_list & ~F.coalesce(kind == "ListItem", F.lit(False))  # lists show their items only
    in_link = F.contains(above, F.lit("a")) & ~is_text & ~F.coalesce(kind.isin("Bold", "Italic"), F.lit(False))
    blank = is_text & above.endswith("t") & ~n["text"].rlike(r"\S")
    return F.when(F.contains(above, F.lit("x")) | above.rlike("[uo][^i]") | stray | in_link | blank, _pair("")).otherwise(out)


def _html_of(indent: bool):
    """n -> (before, after): the HTML before and after what lies below a node."""

    def ends(n: Column) -> Column:
        kind, in_pre = n["elem_kind"], F.contains(n["above"], F.lit("p"))
        href = F.coalesce(get_attr(n["attrs"], "href"), F.lit(""))
        attrs = node_attributes(n["attrs"], n["data_parsoid"], n["data_mw"])
        tag, plain = kind_tag(kind, n["level"], n["tag"]), ("Bold", "Italic", "LineBreak", "HorizontalRule")
        tag = F.when(n["tag"].isin("th", "strong", "em"), F.when(kind.isin(*plain), tag).otherwise(n["tag"])).otherwise(tag)
        link = lambda rel: _pair(F.concat(F.lit(f'<a rel="{rel}" href="'), href, F.lit('"'), node_attributes(F.filter(n["attrs"], lambda a: a["k"] != "rel"), n["data_parsoid"], n["data_mw"]), F.lit(">")), "</a>")
        spaced = kind.isin("Paragraph", "Heading", "Preformatted", "Table", "TableRow", "TableCell", "UnorderedList", "OrderedList", "Div", "HorizontalRule")
        known = kind.isin("Paragraph", "Heading", "Preformatted", "Table", "TableRow", "TableCell", "UnorderedList", "OrderedList", "ListItem", "Div", "Span")
        out = (
            F.when(n["node_kind"] == "Text", _pair(F.when(in_pre, n["text"]).otherwise(html_escape(n["text"]))))
            .when(n["node_kind"] == "Comment", _pair(F.concat(F.lit("<!--"), comment_escape(n["text"]), F.lit("-->"))))
            .when(kind.isin("Bold", "Italic"), _tagged(tag)).when(kind == "LineBreak", _pair("<br/>")).when(kind == "HorizontalRule", _pair("<hr/>\n"))
            .when(kind == "Wikilink", link("mw:WikiLink")).when(kind == "ExtLink", link("mw:ExtLink"))
            .when(kind == "Image", _pair(image_html(F.coalesce(get_attr(n["attrs"], "src"), F.lit("")))))
            .when(known, _tagged(tag, attrs)).otherwise(_tagged(tag, attrs, "\n"))
        )
        if not indent:
            return out
        return F.when(spaced, F.struct(F.concat(F.repeat(F.lit("  "), n["depth"] - 1), out["before"]).alias("before"), out["after"].alias("after"))).otherwise(out)

    return ends


def node_json(*fields: str) -> Column:
    """The fields of a node as one JSON object; those without a value are left out."""
    return F.to_json(F.struct(*fields))


def image_html(src: Column) -> Column:
    return F.concat(F.lit('<figure-inline><img src="'), src, F.lit('"/></figure-inline>'))


def _events(n: Column, ends) -> Column:
    """What a node puts out and where: at its own piece, and before the piece at which it ends."""

    def both(pair: Column) -> Column:
        return F.array(
            F.struct(n["node_id"].alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("tie"), pair["before"].alias("s")),
            F.struct(F.greatest(n["until"], n["node_id"] + 1).alias("at"), F.lit(0).alias("opens"), (-n["node_id"]).alias("tie"), pair["after"].alias("s")),
        )

    return let(ends(n), both)


def _joined(events: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(events), lambda e: e["s"]), "")


def _links_settled(markup: Column) -> Column:
    """Links as they are written: the shown text only where it is not the target."""
    target = f"([^{MARK}]*)"
    markup = F.regexp_replace(markup, rf"{_WIKI}{target}{_SHOWN}(?:\1)?{_DONE}", "[[$1]]")
    markup = F.regexp_replace(markup, rf"{_EXT}{target}{_SHOWN}(?:\[\1\])?{_DONE}", "[$1]")
    markup = F.regexp_replace(markup, rf"(?s){_EXT}(.*?){_SHOWN}(.*?){_DONE}", "[$1 $2]")
    return replaced(markup, (_WIKI, "[["), (_SHOWN, "|"), (_DONE, "]]"), (MARK + "0", MARK))


def _texts(nodes: DataFrame, key: str, ends, name: str, settle=lambda x: x) -> DataFrame:
    own = by_row(key) if ROW in nodes.columns else [key]
    rows = nodes.select(*own, F.struct(*nodes.columns).alias("n"))
    rows = rows.select(*own, F.explode(_events(F.col("n"), ends)).alias("e"))
    return rows.groupBy(*own).agg(_joined(F.collect_list("e")).alias(name)).withColumn(name, settle(F.col(name)))


def nodes_to_html(nodes: DataFrame, key: str = "page_id", indent: bool = False) -> DataFrame:
    """loom_row, key, html: the node table as HTML, one row for each page that has nodes."""
    return _texts(nodes, key, _html_of(indent), "html")


def nodes_to_markup(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """loom_row, key, wikitext: the node table as wiki markup, one row for each page that has nodes."""
    return _texts(nodes, key, _markup_of, "wikitext", _links_settled)


def markup_of_nodes(nodes: Column) -> Column:
    """Wiki markup of an array of nodes."""
    return _links_settled(_joined(F.flatten(F.transform(nodes, lambda n: _events(n, _markup_of)))))


def html2wt(page: Column) -> Column:
    """Wiki markup of a page's body, within the row: nodes in page order, each with what it puts before and after."""
    found = _found(page)
    return markup_of_nodes(_nodes(found, _placed(F.transform(found, _step))))


def html_to_markup(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, wikitext: wiki markup of each page, one row for each input row; a null page gives an empty text."""
    names = names_of(pages, key)
    rows = with_nodes(spread(numbered(pages, key, F.col(html).alias("html"))), F.col("html"), "nodes")
    return rows.select(*names, markup_of_nodes(F.col("nodes")).alias("wikitext"))
