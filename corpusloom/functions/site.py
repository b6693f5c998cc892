"""Site settings: fixed values of the wiki markup language, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Number, name and other names of namespaces.
NAMESPACES = (
    (0, "Main", ()), (1, "Talk", ()), (2, "User", ()), (3, "User talk", ()), (4, "Project", ("Wikipedia",)), (5, "Project talk", ("Wikipedia talk",)),
    (6, "File", ("Image",)), (7, "File talk", ("Image talk",)), (8, "MediaWiki", ()), (9, "MediaWiki talk", ()), (10, "Template", ()), (11, "Template talk", ()),
    (12, "Help", ()), (13, "Help talk", ()), (14, "Category", ()), (15, "Category talk", ()), (828, "Module", ()), (829, "Module talk", ()),
)
# Prefixes of other wikis.
INTERWIKI = (
    ("wikipedia", "https://en.wikipedia.org/wiki/$1"), ("wiktionary", "https://en.wiktionary.org/wiki/$1"), ("wikibooks", "https://en.wikibooks.org/wiki/$1"),
    ("wikiquote", "https://en.wikiquote.org/wiki/$1"), ("commons", "https://commons.wikimedia.org/wiki/$1"), ("meta", "https://meta.wikimedia.org/wiki/$1"),
    ("mw", "https://www.mediawiki.org/wiki/$1"),
)
# Canonical name and spellings of magic words.
MAGIC_WORDS = {
    "toc": ("__TOC__", "__NOTOC__", "__FORCETOC__"), "noeditsection": ("__NOEDITSECTION__", "__NEWSECTIONLINK__"),
    "nogallery": ("__NOGALLERY__",), "hiddencat": ("__HIDDENCAT__",), "index": ("__INDEX__", "__NOINDEX__"),
    "staticredirect": ("__STATICREDIRECT__",), "displaytitle": ("DISPLAYTITLE",),
    "defaultsort": ("DEFAULTSORT", "DEFAULTSORTKEY", "DEFAULTCATEGORYSORT"), "pagename": ("PAGENAME", "PAGENAMEE"),
    "fullpagename": ("FULLPAGENAME", "FULLPAGENAMEE"), "currentyear": ("CURRENTYEAR",),
    "currentmonth": ("CURRENTMONTH", "CURRENTMONTHNAME"), "currentday": ("CURRENTDAY", "CURRENTDAY2"), "currenttime": ("CURRENTTIME",),
    "numberofarticles": ("NUMBEROFARTICLES",), "numberofpages": ("NUMBEROFPAGES",), "numberofusers": ("NUMBEROFUSERS",),
    "numberofedits": ("NUMBEROFEDITS",), "namespace": ("NAMESPACE", "NAMESPACENUMBER"), "revisionid": ("REVISIONID",),
    "revisionday": ("REVISIONDAY", "REVISIONDAY2"), "revisionyear": ("REVISIONYEAR",), "revisiontimestamp": ("REVISIONTIMESTAMP",),
    "server": ("SERVER", "SERVERNAME"), "sitename": ("SITENAME",), "img_thumbnail": ("thumbnail", "thumb"), "img_right": ("right",),
    "img_left": ("left",), "img_center": ("center", "centre"), "img_framed": ("framed", "frame"), "img_frameless": ("frameless",),
}
# Tags that extensions handle.
EXTENSION_TAGS = (
    "ref", "references", "gallery", "poem", "source", "syntaxhighlight", "math", "chem", "hiero", "timeline", "graph", "mapframe",
    "maplink", "indicator", "templatedata", "templatestyles",
)
# Names of variables.
VARIABLES = (
    "PAGENAME", "PAGENAMEE", "FULLPAGENAME", "FULLPAGENAMEE", "NAMESPACE", "NAMESPACENUMBER", "CURRENTYEAR", "CURRENTMONTH",
    "CURRENTMONTHNAME", "CURRENTDAY", "CURRENTDAY2", "CURRENTTIME", "SITENAME", "SERVER", "SERVERNAME",
)
# Tags that end a paragraph.
PARAGRAPH_BREAKING_TAGS = (
    "div", "blockquote", "pre", "table", "tr", "td", "th", "center", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
    "dd", "section", "article", "aside", "nav", "header", "footer", "hr",
)
# Tags of blocks.
BLOCK_TAGS = (
    "div", "p", "table", "tr", "td", "th", "ul", "ol", "li", "dl", "dt", "dd", "section", "h1", "h2", "h3", "h4", "h5", "h6", "pre",
    "blockquote", "hr", "figure", "figcaption", "body",
)
# Tag to kind of element.
TAG_KINDS = {
    "p": "Paragraph", "b": "Bold", "strong": "Bold", "i": "Italic", "em": "Italic", "ul": "UnorderedList", "ol": "OrderedList", "li": "ListItem",
    "dl": "DefinitionList", "dt": "DefinitionTerm", "dd": "DefinitionDescription", "table": "Table", "tr": "TableRow", "td": "TableCell", "th": "TableCell",
    "caption": "TableCaption", "pre": "Preformatted", "hr": "HorizontalRule", "br": "LineBreak", "div": "Div", "span": "Span", "section": "Section",
    "figure": "Figure", "figure-inline": "Figure", "figcaption": "FigCaption", "img": "Image",
}
# Kind of element to tag.
KIND_TAGS = {
    "Document": "html", "Paragraph": "p", "Bold": "b", "Italic": "i", "Wikilink": "a", "ExtLink": "a", "Image": "figure-inline", "Gallery": "ul", "Table": "table",
    "TableRow": "tr", "TableCell": "td", "TableCaption": "caption", "UnorderedList": "ul", "OrderedList": "ol", "ListItem": "li", "DefinitionList": "dl",
    "DefinitionTerm": "dt", "DefinitionDescription": "dd", "Preformatted": "pre", "HorizontalRule": "hr", "Transclusion": "span", "ExtensionTag": "span",
    "Annotation": "meta", "Div": "div", "Span": "span", "LineBreak": "br", "Comment": "", "RawHtml": "", "Section": "section", "InterlanguageLink": "link",
    "CategoryLink": "link", "Redirect": "link", "TableOfContents": "div", "Indicator": "div", "Figure": "figure", "FigCaption": "figcaption",
}
# Facts of the site.
SITE = {"server": "https://en.wikipedia.org", "article_path": "/wiki/$1", "script_path": "/w", "language": "en", "site_name": "Wikipedia"}


def dim_namespace(spark: SparkSession) -> DataFrame:
    rows = [(i, name, list(also), True, "Scribunto" if i == 828 else "wikitext") for i, name, also in NAMESPACES]
    return spark.createDataFrame(rows, "id int, canonical string, aliases array<string>, case_sensitive boolean, content_model string")


def dim_interwiki(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, u, True, False) for p, u in INTERWIKI], "prefix string, url string, local boolean, transclusion_allowed boolean")


def dim_magic_word(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, False, list(v)) for k, v in MAGIC_WORDS.items()], "canonical string, case_sensitive boolean, aliases array<string>")


def dim_extension_tag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in EXTENSION_TAGS], "name string")
