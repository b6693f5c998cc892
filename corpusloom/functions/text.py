"""Escaping, URIs, numbers, substrings, sanitizing: native string expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def spliced(text: Column, pattern: str, put) -> Column:
    """Every match of the pattern replaced by put(match), place by place: what is put in is not read again."""
    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    joined = lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), found(t), one), "")
    one = lambda part, m: F.concat(part, F.when(m.isNull(), "").otherwise(put(m)))
    return let(text, lambda t: F.when(t.rlike(pattern), joined(t)).otherwise(t))


def html_escape(text: Column) -> Column:
    return replaced(text, ("&", "&amp;"), ("<", "&lt;"))


def attr_escape(text: Column) -> Column:
    return replaced(text, ("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&#39;"))


def comment_escape(text: Column) -> Column:
    return replaced(text, ("&", "&#x26;"), ("-", "&#x2D;"), (">", "&#x3E;"))


def json_attr_escape(text: Column) -> Column:
    return replaced(text, ("&", "&amp;"), ("'", "&#39;"))


def text_encode(text: Column) -> Column:
    return replaced(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def text_decode(text: Column) -> Column:
    """Five named references; the ampersand last, so nothing is decoded twice."""
    return replaced(text, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def trim_all(text: Column) -> Column:
    """Trims all Unicode white space, not only U+0020."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def split_literal(text: Column, separator: str) -> Column:
    return F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def attributes(attrs: Column) -> Column:
    """An array of (k, v) as ' k="v"' parts, sorted by key."""
    parts = F.transform(F.array_sort(attrs), lambda a: F.concat(F.lit(" "), a["k"], F.lit('="'), attr_escape(a["v"]), F.lit('"')))
    return F.array_join(parts, "")


def text_tag(name: Column, attrs: Column, content: Column) -> Column:
    """<name attrs>content</name>; without content <name attrs />."""
    start = F.concat(F.lit("<"), name, attributes(attrs))
    return F.when(content.isNull(), F.concat(start, F.lit(" />"))).otherwise(F.concat(start, F.lit(">"), content, F.lit("</"), name, F.lit(">")))


def html_create(tag: Column) -> Column:
    """An empty element."""
    return F.concat(F.lit("<"), tag, F.lit("></"), tag, F.lit(">"))


def uri_encode(text: Column) -> Column:
    return replaced(F.url_encode(text), ("*", "%2A"), ("%7E", "~"))


def uri_decode(text: Column) -> Column:
    """+ is a space, %XX are UTF-8 bytes; a text with a damaged escape stays as it is but for +."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def anchor_encode(text: Column) -> Column:
    return replaced(text, (" ", "_"), ("?", "%3F"), ("#", "%23"))


def format_num(n: Column) -> Column:
    """Thousands separated by commas for whole numbers under 1e15, else the plain number."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, F.format_number(n.cast("decimal(18,0)"), 0)).otherwise(n.cast("string"))


def ustring_len(text: Column) -> Column:
    return F.char_length(text)


def ustring_sub(text: Column, start: Column, length: Column | None = None) -> Column:
    """From the 1-based start (0 or less counts from the end) length characters; a negative length drops that many at the end."""
    n = F.char_length(text)
    first = F.when(start > 0, start).otherwise(F.greatest(n + start + 1, F.lit(1)))
    rest = F.greatest(n - first + 1, F.lit(0))
    if length is None:
        return F.substring(text, first, rest)
    return F.substring(text, first, F.when(length >= 0, length).otherwise(F.greatest(rest + length, F.lit(0))))


def sanitize_attr(text: Column) -> Column:
    return replaced(text, ("javascript:", ""), ("data:", ""))


def sanitize_url(text: Column) -> Column:
    url = trim_all(text)
    return F.when(F.lower(url).startswith("javascript:"), "").otherwise(url)


def normalize_title(text: Column) -> Column:
    return trim_all(F.replace(text, F.lit("_"), F.lit(" ")))


def title_to_url(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def html_document(body: Column, language: Column, body_only: bool = False) -> Column:
    """The page around a body: doctype, language and UTF-8 mark."""
    if body_only:
        return body
    return F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), attr_escape(language), F.lit('">\n<head><meta charset="UTF-8"/></head>\n<body>\n'), body, F.lit("\n</body>\n</html>\n"))


def get_attr(attrs: Column, key: str | Column) -> Column:
    """The first value of the key, else null."""
    return F.try_element_at(F.transform(F.filter(attrs, lambda a: a["k"] == key), lambda a: a["v"]), F.lit(1))


def set_attr(attrs: Column, key: str, value: Column) -> Column:
    """Replaces the value in place, or appends it."""
    own = F.struct(F.lit(key).alias("k"), value.alias("v"))
    changed = F.transform(attrs, lambda a: F.when(a["k"] == key, own).otherwise(F.struct(a["k"].alias("k"), a["v"].alias("v"))))
    return F.when(F.exists(attrs, lambda a: a["k"] == key), changed).otherwise(F.concat(attrs, F.array(own)))


def node_attributes(attrs: Column, data_parsoid: Column, data_mw: Column) -> Column:
    """Sorted attributes without href and src, then the two JSON attributes in single quotes."""
    plain = attributes(F.filter(attrs, lambda a: ~a["k"].isin("href", "src")))
    json = [F.coalesce(F.concat(F.lit(f" {name}='"), json_attr_escape(c), F.lit("'")), F.lit("")) for name, c in (("data-parsoid", data_parsoid), ("data-mw", data_mw))]
    return F.concat(plain, *json)


def body_of(page: Column) -> Column:
    inner = F.regexp_extract(page, r"(?s)<body[^>]*>(.*)</body>", 1)
    return trim_all(F.when(page.rlike(r"(?s)<body[^>]*>.*</body>"), inner).otherwise(page))


def strip_comments(page: Column) -> Column:
    return F.regexp_replace(page, r"(?s)<!--.*?-->", "")


def strip_annotations(page: Column) -> Column:
    """Drops comments, data-parsoid, data-mw, rel and class="new" from HTML that is to be compared."""
    page = strip_comments(page)
    page = F.regexp_replace(page, r""" data-(?:parsoid|mw)='[^']*'""", "")
    page = F.regexp_replace(page, r""" data-(?:parsoid|mw)="[^"]*\"""", "")
    return F.regexp_replace(page, r""" (?:rel="[^"]*"|class="new")""", "")


def strip_transclusion_spans(page: Column) -> Column:
    return F.regexp_replace(page, r"""(?s)<span[^>]* typeof="mw:Transclusion"[^>]*>(.*?)</span>""", "$1")


def normalize_paragraphs(page: Column) -> Column:
    """No line ends before </p> and between paragraphs, no empty <b> and <i>, however deep they are nested."""
    page = F.regexp_replace(page, r"\n+</p>", "</p>")
    page = F.regexp_replace(page, r"</p>\n+<p>", "</p><p>")
    empty = r"<b></b>|<i></i>"
    state = lambda t: let(t, lambda x: F.struct(x.alias("x"), x.rlike(empty).alias("more")))
    turns = F.sequence(F.lit(1), F.regexp_count(page, F.lit("</[bi]>")) + 1)
    return F.aggregate(turns, state(page), lambda s, _: F.when(s["more"], state(F.regexp_replace(s["x"], empty, ""))).otherwise(s), lambda s: s["x"])


def difference_hint(a: Column, b: Column, around: int = 10) -> Column:
    """Where two texts part: the place and the characters around it; null for equal texts.

    The place is found by halving, so the work grows with the length times its logarithm at most.
    """
    n = F.least(F.char_length(a), F.char_length(b))

    def halve(s: Column, _: Column) -> Column:  # the first ``same`` characters agree; beyond ``most`` they cannot
        middle = F.floor((s["same"] + s["most"] + 1) / 2).cast("int")
        agree = F.substring(a, s["same"] + 1, middle - s["same"]) == F.substring(b, s["same"] + 1, middle - s["same"])
        return F.struct(F.when(agree, middle).otherwise(s["same"]).alias("same"), F.when(agree, s["most"]).otherwise(middle - 1).alias("most"))

    turns = F.sequence(F.lit(1), F.ceil(F.log2(n + 2)).cast("int") + 1)
    at = F.aggregate(turns, F.struct(F.lit(0).alias("same"), n.alias("most")), halve, lambda s: s["same"] + 1)
    part = lambda t: F.substring(t, F.greatest(at - around, F.lit(1)), F.lit(2 * around))
    return F.when(a != b, F.concat(F.lit("at "), at.cast("string"), F.lit(": "), part(a), F.lit(" / "), part(b)))
