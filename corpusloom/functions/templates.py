"""Template invocations, arguments, inclusion sections and parser functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .braces import GROUP, MARK, guarded, held, is_argument, released, while_open
from .site import SITE, VARIABLES
from .text import attr_escape, let, replaced, spliced, trim_all

ERROR = '<strong class="error">Expression error: {}</strong>'


def parse_invocation(text: Column) -> Column:
    """'name|a|k=v' to (name, positional, named); of equal names the last counts."""
    parts = F.split(text, r"\|", -1)
    rest = F.slice(parts, 2, F.size(parts))
    named = F.filter(rest, lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(named, lambda p: F.struct(trim_all(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.char_length(p)).alias("value")))
    return F.struct(trim_all(F.get(parts, 0)).alias("name"), F.filter(rest, lambda p: ~F.contains(p, F.lit("="))).alias("positional"), last_entries(entries).alias("named"))


def last_entries(entries: Column) -> Column:
    """A map of (key, value) entries in which the last of equal keys counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def template_args(call: Column) -> Column:
    """All arguments by name: positional ones as 1, 2, ..., overridden by named ones."""
    counted = F.transform(call["positional"], lambda v, i: F.struct((i + 1).cast("string").alias("key"), v.alias("value")))
    named = F.transform(F.map_entries(call["named"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return last_entries(F.concat(counted, named))


def get_arg(call: Column, name: Column) -> Column:
    return F.coalesce(F.try_element_at(call["named"], name), F.try_element_at(call["positional"], F.nullif(F.try_to_number(name, F.lit("999999")).cast("int"), F.lit(0))))


def arg_reference(text: Column) -> Column:
    """'name' or 'name|default' to (name, dflt); no default is null, an empty one is empty."""
    bar = F.instr(text, "|")
    return F.struct(trim_all(F.when(bar > 0, F.substring(text, F.lit(1), bar - 1)).otherwise(text)).alias("name"), F.when(bar > 0, F.substring(text, bar + 1, F.char_length(text))).alias("dflt"))


def resolve_arg(value: Column, default: Column) -> Column:
    return F.coalesce(value, default, F.lit(""))


def magic_pipe(text: Column) -> Column:
    return F.replace(text, F.lit("{{!}}"), F.lit("|"))


#: A bar that separates nothing; braces of a template's own text, which are read again later.
BAR, _OPEN, _CLOSE = (MARK + digit for digit in "789")


def with_args(body: Column, args: Column) -> Column:
    """A held body with every {{{name|default}}} answered from args, whose names and values are held.

    Groups are settled from the innermost outwards until none is left, so arguments may stand in
    defaults and names of others, and calls in defaults, at any depth.
    """

    def value(group: Column) -> Column:
        inner = F.substring(group, F.lit(4), F.char_length(group) - 6)
        return let(arg_reference(inner), lambda r: resolve_arg(F.try_element_at(args, r["name"]), r["dflt"]))

    def put(group: Column) -> Column:
        return F.when(is_argument(group), value(group)).otherwise(replaced(group, ("{", _OPEN), ("}", _CLOSE)))

    settled = while_open(body, lambda t: t.rlike(GROUP), lambda t: spliced(t, GROUP, put))
    return replaced(settled, (_OPEN, "{"), (_CLOSE, "}"))


def substitute_args(body: Column, args: Column) -> Column:
    """Replaces every {{{name|default}}}, however deep, then {{!}}; what a value brings is not read again."""
    names, values = F.transform(F.map_keys(args), guarded), F.transform(F.map_values(args), lambda v: held(guarded(v)))
    return magic_pipe(released(let(F.map_from_arrays(names, values), lambda own: with_args(guarded(body), own))))


def without_noinclude(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(?s)<noinclude>.*?</noinclude>", ""), F.lit("<noinclude>"), F.lit(""))


def without_includeonly_tags(text: Column) -> Column:
    return replaced(text, ("<includeonly>", ""), ("</includeonly>", ""))


def only_onlyinclude(text: Column) -> Column:
    parts = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<onlyinclude>(.*?)</onlyinclude>"), F.lit(1)), "")
    return F.when(F.contains(text, F.lit("<onlyinclude>")), parts).otherwise(text)


def template_body(text: Column) -> Column:
    """What a template gives to the pages that include it."""
    return only_onlyinclude(without_includeonly_tags(without_noinclude(text)))


def top_level_arg(text: Column) -> Column:
    """{{{name|default}}} on a page itself: the default, else the name in braces."""
    ref = arg_reference(text)
    return F.coalesce(ref["dflt"], F.concat(F.lit("{"), ref["name"], F.lit("}")))


# ---------------------------------------------------------------- parser functions


def pf_if(test: Column, yes: Column, no: Column) -> Column:
    return F.when(trim_all(test) != "", yes).otherwise(F.coalesce(no, F.lit("")))


def pf_ifeq(a: Column, b: Column, yes: Column, no: Column) -> Column:
    return F.when(trim_all(a) == trim_all(b), yes).otherwise(F.coalesce(no, F.lit("")))


def pf_switch(value: Column, cases: Column) -> Column:
    """cases: array of 'k=v' and 'default' strings; an exact match, else the last without =, else ''."""
    hit = F.filter(cases, lambda c: F.contains(c, F.lit("=")) & (trim_all(F.split_part(c, F.lit("="), F.lit(1))) == trim_all(value)))
    rest = F.filter(cases, lambda c: ~F.contains(c, F.lit("=")))
    text = F.get(hit, 0)
    return F.coalesce(trim_all(F.substring(text, F.instr(text, "=") + 1, F.char_length(text))), trim_all(F.try_element_at(rest, F.lit(-1))), F.lit(""))


def pf_ifexpr(result: Column, yes: Column, no: Column) -> Column:
    return F.when((result != "0") & (result != ""), yes).otherwise(F.coalesce(no, F.lit("")))


def pf_iferror(value: Column, bad: Column, good: Column) -> Column:
    failed = F.contains(value, F.lit('<strong class="error">'))
    return F.when(failed, F.coalesce(bad, value)).otherwise(F.coalesce(good, value))


def pf_tag(name: Column, content: Column, attrs: Column) -> Column:
    """<tag attrs>content</tag>, or <tag attrs/> without content; attrs is a map, sorted by key."""
    tag = F.when(trim_all(name) == "", "span").otherwise(trim_all(name))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), attr_escape(e["value"]), F.lit('"'))), "")
    start = F.concat(F.lit("<"), tag, listed)
    return F.when(content == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), content, F.lit("</"), tag, F.lit(">")))


def pf_titleparts(title: Column, segments: Column, first: Column) -> Column:
    """segments parts of the title from the first-th (1-based; both at least 1)."""
    return F.array_join(F.slice(F.split(title, "/", -1), F.greatest(first, F.lit(1)), F.greatest(segments, F.lit(1))), "/")


def format_result(x: Column) -> Column:
    """Whole numbers without decimals, others with six at most and no trailing zeros."""
    decimals = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(decimals)


def _value(text: str) -> float:
    """One arithmetic text by precedence climbing; unknown signs are skipped, missing operands are 0."""
    import re

    marks, at = re.findall(r"\d+\.?\d*|\.\d+|[-+*/%()]", text), 0

    def factor() -> float:
        nonlocal at
        mark = marks[at] if at < len(marks) else ")"
        if mark in "-+":
            at += 1
            return -factor() if mark == "-" else factor()
        if mark == "(":
            at += 1
            inner = chain(0)
            at += at < len(marks) and marks[at] == ")"
            return inner
        if mark in "*/%)":
            return 0.0
        at += 1
        return float(mark)

    def chain(level: int) -> float:
        nonlocal at
        left = factor() if level == 1 else chain(1)
        while at < len(marks) and marks[at] in ("+-", "*/%")[level]:
            sign = marks[at]
            at += 1
            right = factor() if level == 1 else chain(1)
            if sign in "/%" and right == 0:
                raise ZeroDivisionError
            left = left + right if sign == "+" else left - right if sign == "-" else left * right if sign == "*" else left / right if sign == "/" else left - right * int(left / right)
        return left

    return chain(0) if marks else float("nan")


@F.pandas_udf(T.DoubleType())
def _values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> float | None:
        try:
            return _value(text or "")
        except ZeroDivisionError:
            return float("inf")

    for texts in batches:
        yield texts.map(one).astype("float64")


def pf_expr(text: Column) -> Column:
    """The value of an arithmetic text, formatted; '' for an empty one, an error text for division by zero."""
    x = _values(text)
    return F.when(x.isNull() | F.isnan(x), "").when(x == float("inf"), ERROR.format("Division by zero")).otherwise(format_result(x))


def variable(name: Column, page: dict[str, str] | None = None, site: dict[str, str] | None = None, now: Column | None = None) -> Column:
    """The value of a page variable; other known names come back in braces, unknown ones as null.

    page gives page_name; dates are those of now, by default the time at which the query runs.
    """
    page, site, upper = {"page_name": "TestPage"} | (page or {}), SITE | (site or {}), F.upper(name)
    now = F.current_timestamp() if now is None else now
    values = {
        "PAGENAME": F.lit(page["page_name"]), "FULLPAGENAME": F.lit(page["page_name"]), "SITENAME": F.lit(site["site_name"]),
        "SERVER": F.lit(site["server"]), "SERVERNAME": F.lit(site["server"]), "CURRENTYEAR": F.date_format(now, "yyyy"),
        "CURRENTMONTH": F.date_format(now, "MM"), "CURRENTDAY": F.date_format(now, "d"), "CURRENTDAY2": F.date_format(now, "dd"),
    }
    out = F.when(upper.isin(list(VARIABLES)), F.concat(F.lit("{{"), name, F.lit("}}")))
    for key, value in values.items():
        out = F.when(upper == key, value).otherwise(out)
    return out


def is_variable(name: Column) -> Column:
    return F.upper(name).isin(list(VARIABLES))


# ---------------------------------------------------------------- JSON envelopes


def template_markup(data_mw: Column) -> Column:
    """{{T|k=v}} from data-mw; parts that are plain strings are left out."""
    parts = F.from_json(F.get_json_object(data_mw, "$.parts"), "array<string>")
    shape = "template struct<target:struct<wt:string>,params:map<string,struct<wt:string>>>"
    kept = F.transform(F.filter(parts, lambda p: p.startswith("{")), lambda p: F.from_json(p, shape))
    one = lambda t: F.concat(F.lit("{{"), t["target"]["wt"], F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(t["params"]), lambda e: F.struct(e["key"].alias("k"), e["value"]["wt"].alias("v")))), lambda e: F.concat(F.lit("|"), e["k"], F.lit("="), e["v"])), ""), F.lit("}}"))
    return F.array_join(F.transform(kept, lambda p: one(p["template"])), "")


def extension_markup(data_mw: Column) -> Column:
    """<name attrs>source</name> from data-mw, <name attrs/> without a source, <ext/> without a name."""
    x = F.from_json(data_mw, "name string, attrs map<string,string>, body struct<extsrc:string>")
    attrs = F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(x["attrs"])), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"'))), ""), F.lit(""))
    full = F.concat(F.lit("<"), x["name"], attrs, F.lit(">"), x["body"]["extsrc"], F.lit("</"), x["name"], F.lit(">"))
    return F.coalesce(full, F.concat(F.lit("<"), x["name"], attrs, F.lit("/>")), F.lit("<ext/>"))


def source_range(data_parsoid: Column) -> Column:
    """(s, e, ow, cw) from data-parsoid; null unless dsr holds exactly four whole numbers from 0."""
    d = F.from_json(F.get_json_object(data_parsoid, "$.dsr"), "array<bigint>")
    ok = (F.size(d) == 4) & F.forall(d, lambda x: x.isNotNull() & (x >= 0))
    return F.when(ok, F.struct(F.get(d, 0).alias("s"), F.get(d, 1).alias("e"), F.get(d, 2).alias("ow"), F.get(d, 3).alias("cw")))


def content_range(dsr: Column) -> Column:
    return F.struct((dsr["s"] + dsr["ow"]).alias("s"), (dsr["e"] - dsr["cw"]).alias("e"))
