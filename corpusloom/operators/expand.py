"""Template expansion over a corpus as repeated joins, innermost invocations first.

Each round lays out the innermost {{...}} of every page that still has one, answers parser functions
and variables by native expressions, looks templates up by one join, and puts the answers back into
the page, place by place. Pages without an open invocation leave the loop. Depth bounds the rounds,
so templates that call themselves end; what is left then stays as it is.

Between the rounds single braces, braces in comments and nowiki, and calls that are to stay are held
(functions/braces.py), so they are never taken for calls and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.braces import CALL, GROUP, LEFT, LITERAL, RIGHT, guarded, held, is_argument, is_call, released, while_open
from ..functions.templates import (
    BAR, is_variable, parse_invocation, pf_expr, pf_if, pf_ifeq, pf_iferror, pf_ifexpr, pf_switch, pf_tag, pf_titleparts,
    template_args, template_body, top_level_arg, variable, with_args,
)
from ..functions.text import let, spliced, trim_all
from ..staging import staged
from .rows import ROW, by_row, names_of, numbered, spread
from .tokens import tokens

MAX_DEPTH = 40
EXPRESSION = r"(?i)\{\{\s*#(?:if)?expr\s*[:|}]"


def _with_function_value(calls: DataFrame, numbers: bool) -> DataFrame:
    """Adds f_value, what '#name:first|...' gives; unknown functions become {{#name|...}}.

    Parts that several functions use are columns of their own, so each is worked out once. Without
    ``numbers`` no call of the round is arithmetic, and no row goes through the Python helper.
    """
    name, args, none = F.col("call.name"), F.col("call.positional"), F.lit("")
    after_colon = F.when(F.instr(name, ":") > 0, F.substring(name, F.instr(name, ":") + 1, F.char_length(name)))
    calls = calls.withColumns({"f_name": F.lower(trim_all(F.split_part(name, F.lit(":"), F.lit(1)))), "f_first": trim_all(F.coalesce(after_colon, F.get(args, 0), none)), "f_a": trim_all(F.get(args, 0)), "f_b": trim_all(F.get(args, 1)), "f_c": trim_all(F.get(args, 2))})
    value = pf_expr(F.when(F.col("f_name").isin("#expr", "#ifexpr"), F.col("f_first"))) if numbers else F.lit("")
    calls = calls.withColumn("f_number", value)
    cases = F.concat(F.transform(F.map_entries("call.named"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), args)
    f, first, a, b, c = F.col("f_name"), F.col("f_first"), F.col("f_a"), F.col("f_b"), F.col("f_c")
    some = lambda x: F.coalesce(x, none)
    value = (
        F.when(f == "#if", pf_if(first, some(a), b)).when(f == "#ifeq", pf_ifeq(first, some(a), some(b), c)).when(f == "#switch", pf_switch(first, cases))
        .when(f == "#expr", F.col("f_number")).when(f == "#ifexpr", pf_ifexpr(F.col("f_number"), some(a), b)).when(f == "#iferror", pf_iferror(first, a, b))
        .when(f == "#tag", pf_tag(first, some(a), F.col("call.named"))).when(f == "#titleparts", pf_titleparts(first, F.coalesce(a.try_cast("int"), F.lit(1)), F.coalesce(b.try_cast("int"), F.lit(1))))
        .when(f == "#ifexist", F.when(F.col("p_name").isNotNull(), some(a)).otherwise(some(b))).when(f.startswith("#"), held(F.concat(F.lit("{{"), f, F.lit("|...}}"))))
    )
    return calls.withColumn("f_value", value)


def _settled(x: Column) -> Column:
    """Answers the arguments on the page itself and holds single braces, as far as no call stands inside."""
    put = lambda g: F.when(is_argument(g), held(top_level_arg(F.substring(g, F.lit(4), F.char_length(g) - 6)))).when(is_call(g), g).otherwise(held(g))
    is_open = lambda t: F.exists(F.regexp_extract_all(t, F.lit(GROUP), F.lit(0)), lambda g: ~is_call(g))
    return while_open(x, is_open, lambda t: spliced(t, GROUP, put))


def _parsed(group: Column) -> Column:
    """(inner, call, args) of one {{...}}."""
    inner = F.substring(group, F.lit(3), F.char_length(group) - 4)
    call = lambda x: let(parse_invocation(x), lambda c: F.struct(x.alias("inner"), c.alias("call"), template_args(c).alias("args")))
    return let(inner, call)


def expand_templates(
    docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", pages: DataFrame | None = None, max_depth: int = MAX_DEPTH,
    missing: str | None = "", wrap: bool = False, now: Column | None = None,
) -> DataFrame:
    """key, expanded. templates: title, content. pages: title of existing pages, for #ifexist.

    A template that does not exist gives ``missing``; of several with one title the smallest text
    counts. With wrap, what a template gives stands in a transclusion span, and calls of templates
    that do not exist stay as they are. now is the time for date variables. Each round has two joins
    on names and one on the row's number; sizes of the template side are Spark's to check.

    Rows: every input row gives one row, whether its key is null or repeated; a null text is empty;
    templates without a title are never asked for; other columns are left out.
    """
    titled = templates.where("title is not null")
    bodies = titled.groupBy(F.col("title").alias("t_name")).agg(F.min(guarded(template_body(F.coalesce("content", F.lit(""))))).alias("body"))
    known = (pages if pages is not None else templates.limit(0)).select(F.col("title").alias("p_name")).distinct()
    start = spliced(guarded(F.coalesce("x", F.lit(""))), LITERAL, held)
    rows, done = spread(numbered(docs, key, F.col(text).alias("x"))).withColumn("x", start), None
    names = names_of(docs, key)
    shown = lambda df: df.select(*names, released(F.col("x")).alias("expanded"))
    for _ in range(max_depth):
        rows = staged(rows.withColumn("x", _settled(F.col("x"))))
        is_open = F.col("x").rlike(CALL)
        n_open, n_numbers = rows.agg(F.count_if(is_open), F.count_if(F.col("x").rlike(EXPRESSION))).first()
        closed = rows.where(~is_open)
        done = closed if done is None else done.union(closed)
        if not n_open:
            return shown(done)
        still = rows.where(is_open)
        groups = F.regexp_extract_all("x", F.lit(CALL), F.lit(0))
        calls = still.select(ROW, F.posexplode(F.transform(groups, _parsed)).alias("place", "c")).select(ROW, "place", "c.inner", "c.call", "c.args")
        name = F.col("call.name")
        asked = F.when(name.rlike("(?i)^#ifexist"), trim_all(F.regexp_replace(name, "(?i)^#ifexist[^:]*:", "")))
        calls = calls.withColumns({"asked": asked, "t_key": F.regexp_replace(name, "(?i)^template:", "")})
        calls = calls.join(bodies, F.col("t_key") == F.col("t_name"), "left").join(known, F.col("asked") == F.col("p_name"), "left")
        calls = _with_function_value(calls, n_numbers > 0)
        from_template = with_args(F.col("body"), F.col("args"))
        if wrap:
            from_template = F.concat(F.lit('<span typeof="mw:Transclusion">'), from_template, F.lit("</span>"))
        echoed = held(variable(name, now=now))  # names without a value come back in braces
        plain = F.coalesce(F.when(name == "!", BAR), F.when(~F.contains("inner", F.lit("|")), echoed), from_template, F.lit(missing))
        value = F.when(name.startswith("#"), F.col("f_value")).otherwise(plain)
        if wrap:
            is_known = F.col("t_name").isNotNull() | name.startswith("#") | is_variable(name) | (name == "!")
            value = F.when(is_known, value).otherwise(F.concat(F.lit(2 * LEFT), "inner", F.lit(2 * RIGHT)))
        answers = calls.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))).alias("answers"))
        pieces = F.zip_with(F.split("x", CALL, -1), "answers", lambda part, a: F.concat(part, F.coalesce(a["value"], F.lit(""))))
        rows = still.join(answers, ROW).select(*by_row(key), F.array_join(pieces, "").alias("x"))
    return shown(done.union(rows) if done is not None else rows)


def expanded_tokens(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The tokens of each row's text after expansion, with the options of expand_templates."""
    return tokens(expand_templates(numbered(docs, key, text), templates, key, text, **options), key, "expanded")


def template_lookup(refs: DataFrame, templates: DataFrame, name: str = "name") -> DataFrame:
    """refs with content: null for a missing template."""
    return refs.join(templates.select(F.col("title").alias(name), "content"), name, "left")
