"""Queries of the native string, title and template functions, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import site, templates, text, titles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _column(name: str, table: str, key: str, make, sql: str, out: str = "out") -> None:
    """A query of one expression over one table."""
    query(name, f"select {key}, {sql} as {out} from {table}")(lambda spark, d: read(spark, d, table).select(key, make().alias(out)))


C = F.col
_column(
    "html_escape",
    "documents",
    "doc_id",
    lambda: text.html_escape(C("text")),
    "replace(replace(text, '&', '&amp;'), '<', '&lt;')",
)
_column(
    "attr_escape",
    "pages",
    "page_id",
    lambda: text.attr_escape(C("html")),
    "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;'), '''', '&#39;')",
)
_column(
    "comment_escape",
    "documents",
    "doc_id",
    lambda: text.comment_escape(C("text")),
    "replace(replace(replace(text, '&', '&#x26;'), '-', '&#x2D;'), '>', '&#x3E;')",
)
_column(
    "json_attr_escape",
    "pages",
    "page_id",
    lambda: text.json_attr_escape(C("html")),
    "replace(replace(html, '&', '&amp;'), '''', '&#39;')",
)
_column(
    "text_encode",
    "pages",
    "page_id",
    lambda: text.text_encode(C("html")),
    "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
    "'''', '&#039;')",
)
_column(
    "text_decode",
    "pages",
    "page_id",
    lambda: text.text_decode(C("html")),
    "replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', "
    "''''), '&#39;', ''''), '&amp;', '&')",
)
_column(
    "escape_round_trip",
    "pages",
    "page_id",
    lambda: text.text_decode(text.text_encode(C("html"))) == C("html"),
    "true",
    "same",
)
_column(
    "text_trim",
    "documents",
    "doc_id",
    lambda: text.trim_all(F.concat(F.lit(" \n\t"), C("text"), F.lit("\r\n "))),
    "trim(text, E' \\n\\t\\r')",
)
_column(
    "text_split",
    "customer",
    "c_custkey",
    lambda: F.array_join(text.split_literal(C("c_name"), "#"), "~"),
    "array_to_string(string_split(c_name, '#'), '~')",
)
_column(
    "text_tag",
    "part",
    "p_partkey",
    lambda: text.text_tag(
        F.lit("span"),
        F.array(
            F.struct(F.lit("title").alias("k"), C("p_type").alias("v")),
            F.struct(F.lit("class").alias("k"), C("p_brand").alias("v")),
        ),
        C("p_name"),
    ),
    "'<span class=\"' || p_brand || '\" title=\"' || p_type || '\">' || p_name || '</span>'",
)
_column(
    "uri_encode",
    "pages",
    "page_id",
    lambda: text.uri_encode(F.concat(C("url"), F.lit(" *~é"))),
    "replace(url_encode(url || ' *~é'), '%20', '+')",
)
_column("uri_decode", "pages", "page_id", lambda: text.uri_decode(text.uri_encode(C("url"))), "url")
_column(
    "anchor_encode",
    "pages",
    "page_id",
    lambda: text.anchor_encode(F.concat(C("url"), F.lit(" a b"))),
    "replace(replace(replace(url || ' a b', ' ', '_'), '?', '%3F'), '#', '%23')",
)
_column(
    "format_num",
    "orders",
    "o_orderkey",
    lambda: text.format_num(F.floor("o_totalprice") * F.when(C("o_orderkey") % 2 == 0, -1).otherwise(1)),
    "format('{:,}', floor(o_totalprice)::bigint * case when o_orderkey % 2 = 0 then -1 else 1 end)",
)
_column(
    "ustring_len",
    "documents",
    "doc_id",
    lambda: text.ustring_len(C("text")).cast("long"),
    "length(text)::bigint",
    "n",
)
_column(
    "ustring_sub",
    "documents",
    "doc_id",
    lambda: F.concat_ws(
        "|",
        text.ustring_sub(C("text"), F.lit(3), F.lit(7)),
        text.ustring_sub(F.substring("text", 1, 9), F.lit(-4)),
        text.ustring_sub(F.substring("text", 1, 9), F.lit(2), F.lit(-3)),
    ),
    "substring(text, 3, 7) || '|' || (case when length(substring(text, 1, 9)) <= 4 then substring(text, 1, 9) else "
    "right(substring(text, 1, 9), 4) end) || '|' || substring(substring(text, 1, 9), 2, greatest(0, "
    "length(substring(text, 1, 9)) - 4))",
)
_column("ustring_lower", "documents", "doc_id", lambda: F.lower("text"), "lower(text)")
query("ustring_upper", "select doc_id, upper(text) as out from documents where not contains(text, 'ß')")(
    lambda s, d: read(s, d, "documents").where(~C("text").contains("ß")).select("doc_id", F.upper("text").alias("out"))
)
# the SQL of ustring_upper and ustring_sub leaves out rows with ß and cuts the texts; these take every row and the whole text
query(
    "ustring_upper_whole",
    "select doc_id, upper(replace(text, 'ß', 'SS')) as out from documents",
)(lambda s, d: read(s, d, "documents").select("doc_id", F.upper("text").alias("out")))
_column(
    "ustring_sub_whole",
    "documents",
    "doc_id",
    lambda: F.concat(
        text.ustring_sub(C("text"), F.lit(3), F.lit(7)),
        F.lit("|"),
        text.ustring_sub(C("text"), F.lit(-4)),
        F.lit("|"),
        text.ustring_sub(C("text"), F.lit(2), F.lit(-3)),
    ),
    "substring(text, 3, 7) || '|' || (case when length(text) <= 4 then text else right(text, 4) end) || '|' || "
    "substring(text, 2, greatest(0, length(text) - 4))",
)
_column(
    "sanitize_attr",
    "pages",
    "page_id",
    lambda: text.sanitize_attr(F.concat(F.lit("x javascript:data:"), C("url"))),
    "'x ' || url",
)
_column(
    "sanitize_url",
    "pages",
    "page_id",
    lambda: text.sanitize_url(
        F.concat(F.when(C("page_id") % 3 == 0, " JavaScript:").otherwise(" "), C("url"), F.lit(" "))
    ),
    "case when page_id % 3 = 0 then '' else url end",
)
_column(
    "title_normalize",
    "part",
    "p_partkey",
    lambda: text.normalize_title(F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "))),
    "trim(p_name)",
)
_column("title_url", "part", "p_partkey", lambda: text.title_to_url(C("p_name")), "replace(p_name, ' ', '_')")
_column(
    "html_document",
    "nation",
    "n_nationkey",
    lambda: text.html_document(C("n_name"), F.lit("en")),
    "'<!DOCTYPE html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head><meta charset=\"UTF-8\"/></head>' || "
    "chr(10) || '<body>' || chr(10) || n_name || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)",
)
_column(
    "attr_sort",
    "part",
    "p_partkey",
    lambda: text.attributes(
        F.array(
            *(
                F.struct(F.lit(k).alias("k"), C(v).alias("v")) for k, v in(
                    ("t", "p_type"),
                    ("b", "p_brand"),
                    ("n", "p_name"),
                )
            )
        )
    ),
    "' b=\"' || p_brand || '\" n=\"' || p_name || '\" t=\"' || p_type || '\"'",
)
_column(
    "attr_get_set",
    "part",
    "p_partkey",
    lambda: F.concat_ws(
        "|",
        *(
            F.coalesce(
                text.get_attr(
                    text.set_attr(
                        text.set_attr(
                            F.array(F.struct(F.lit("a").alias("k"), C("p_type").alias("v"))),
                            "a",
                            C("p_name"),
                        ),
                        "b",
                        C("p_brand"),
                    ),
                    k,
                ),
                F.lit("-"),
            ) for k in "abc"
        ),
    ),
    "p_name || '|' || p_brand || '|-'",
)
_column(
    "node_attributes",
    "nation",
    "n_nationkey",
    lambda: text.node_attributes(
        F.array(
            F.struct(F.lit("href").alias("k"), F.lit("x").alias("v")),
            F.struct(F.lit("id").alias("k"), C("n_name").alias("v")),
        ),
        F.concat(F.lit('{"a":"'), C("n_name"), F.lit("'\"}")),
        F.lit(None).cast("string"),
    ),
    "' id=\"' || n_name || '\" data-parsoid=''{\"a\":\"' || n_name || '&#39;\"}'''",
)

# titles
_title = lambda: titles.parse_title(
    F.concat(
        F.when(C("p_partkey") % 5 == 0, "Template:").when(C("p_partkey") % 5 == 1, ":Category:").when(
            C("p_partkey") % 5 == 2,
            "commons:File:",
        ).when(C("p_partkey") % 5 == 3, "image: ").otherwise(""),
        C("p_name"),
        F.lit("#"),
        C("p_brand"),
    )
)
_CASES = "case p_partkey % 5 when 0 then {} when 1 then {} when 2 then {} when 3 then {} else {} end"


@query(
    "title_parse",
    "select p_partkey, case when p_partkey % 5 = 2 then 'commons' end as interwiki, "
    f"({_CASES.format(10, 0, 0, 6, 0)})::int as ns, "
    f"{_CASES.format('p_name', "'Category:' || p_name", "'File:' || p_name", 'p_name', 'p_name')} as title, "
    "p_brand as fragment from part",
)
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", _title().alias("t")).select("p_partkey", "t.interwiki", "t.ns", F.col("t.text").alias("title"), "t.fragment")


_FULL = _CASES.format(
    "'Template:' || p_name",
    "'Category:' || p_name",
    "'File:' || p_name",
    "'File:' || p_name",
    "p_name",
)
query("title_full_text", f"select p_partkey, {_FULL} as out from part")(
    lambda s, d: read(s, d, "part").select("p_partkey", _title().alias("t")).select(
        "p_partkey",
        titles.full_text(C("t")).alias("out"),
    )
)
query(
    "title_display",
    f"select p_partkey, case when p_partkey % 5 = 2 then 'commons:' else '' end || {_FULL} || '#' || p_brand as out "
    f"from part",
)(
    lambda s, d: read(s, d, "part").select("p_partkey", _title().alias("t")).select(
        "p_partkey",
        titles.display_title(C("t")).alias("out"),
    )
)
query(
    "title_facts",
    "select n_nationkey, n_name || '/x' as text, 'Help' as ns_text, 12 as namespace, 'Help:' || n_name || '/x' as "
    "full_text, '' as fragment, n_name as root_text, false as exists, false as is_redirect from nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        titles.title_facts(titles.parse_title(F.concat(F.lit("help:"), "n_name", F.lit("/x")))).alias("t"),
    ).select("n_nationkey", "t.*")
)
_column(
    "template_title",
    "nation",
    "n_nationkey",
    lambda: titles.full_text(
        titles.template_title(F.concat(F.when(C("n_nationkey") % 2 == 0, "User:").otherwise(""), C("n_name")))
    ),
    "case when n_nationkey % 2 = 0 then 'User:' else 'Template:' end || n_name",
)
_column(
    "title_prefixing",
    "nation",
    "n_nationkey",
    lambda: titles.with_prefix(F.concat(F.when(C("n_nationkey") % 2 == 0, "X:").otherwise(""), C("n_name")), "Module"),
    "case when n_nationkey % 2 = 0 then 'X:' else 'Module:' end || n_name",
)
_column(
    "redirect_target",
    "nation",
    "n_nationkey",
    lambda: titles.redirect_target(
        F.concat(F.when(C("n_nationkey") % 2 == 0, "#redirect [[").otherwise("see [["), C("n_name"), F.lit("]] x"))
    ),
    "case when n_nationkey % 2 = 0 then n_name end",
)
_column(
    "parse_wikilink",
    "part",
    "p_partkey",
    lambda: F.to_json(titles.parse_wikilink(F.concat(F.lit("File:"), C("p_name"), F.lit("|"), C("p_brand")))),
    """'{"title":{"ns":6,"text":"' || p_name || '"},"display":"' || p_brand || '"}'""",
)
_column(
    "parse_extlink",
    "pages",
    "page_id",
    lambda: titles.parse_extlink(F.concat(F.lit(" "), C("url")), F.lit(""))["url"],
    "url",
)
_column(
    "wikilink_html",
    "part",
    "p_partkey",
    lambda: titles.wikilink_html(C("p_name"), C("p_brand")),
    "'<a rel=\"mw:WikiLink\" href=\"./' || replace(p_name, ' ', '_') || '\" title=\"' || p_name || '\">' || p_brand "
    "|| '</a>'",
)
_column(
    "extlink_html",
    "pages",
    "page_id",
    lambda: titles.extlink_html(C("url"), F.lit("")),
    "'<a rel=\"mw:ExtLink\" href=\"' || url || '\">[' || replace(url, '&', '&amp;') || ']</a>'",
)
_column(
    "link_markup",
    "part",
    "p_partkey",
    lambda: F.concat(
        titles.wikilink_markup(C("p_name"), F.when(C("p_partkey") % 2 == 0, C("p_name")).otherwise(C("p_brand"))),
        titles.extlink_markup(C("p_brand"), F.concat(F.lit("["), C("p_brand"), F.lit("]"))),
    ),
    "'[[' || p_name || case when p_partkey % 2 = 0 then '' else '|' || p_brand end || ']][' || p_brand || ']'",
)
query(
    "magic_words",
    "select column0 as alias, column1 as canonical from (values ('__notoc__', 'toc'), ('PageName', 'pagename'), "
    "('centre', 'img_center'), ('nothing', null)) v(column0, column1)",
)(
    lambda s, d: s.createDataFrame(
        [("__notoc__",), ("PageName",), ("centre",), ("nothing",)],
        "alias string",
    ).select("alias", titles.magic_word(C("alias")).alias("canonical"))
)
query(
    "site_tables",
    "select 'namespace' as name, 18::bigint as n union all select 'interwiki', 7 union all select 'magic_word', 31 "
    "union all select 'extension_tag', 16",
)(
    lambda s, d: site.dim_namespace(s).select(F.lit("namespace").alias("name")).union(
        site.dim_interwiki(s).select(F.lit("interwiki"))
    ).union(
        site.dim_magic_word(s).select(F.lit("magic_word"))
    ).union(
        site.dim_extension_tag(s).select(F.lit("extension_tag"))
    ).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
)

# templates and arguments
_call = lambda: templates.parse_invocation(
    F.concat(F.lit(" T |"), C("p_name"), F.lit("| k = x|k="), C("p_brand"), F.lit("|2=two"))
)
query(
    "parse_invocation",
    "select p_partkey, 'T' as name, p_name as first, p_brand as k, 2::bigint as n_named from part",
)(
    lambda s, d: read(s, d, "part").select("p_partkey", _call().alias("c")).select(
        "p_partkey",
        "c.name",
        F.get("c.positional", F.lit(0)).alias("first"),
        F.element_at("c.named", "k").alias("k"),
        F.size("c.named").cast("long").alias("n_named"),
    )
)
query(
    "template_args",
    "select p_partkey, p_name as one, 'two' as two, p_brand as k, true as has_k, p_name as got from part",
)(
    lambda s, d: read(s, d, "part").select("p_partkey", _call().alias("c")).select(
        "p_partkey",
        "c",
        templates.template_args(C("c")).alias("a"),
    ).select(
        "p_partkey",
        F.element_at("a", "1").alias("one"),
        F.element_at("a", "2").alias("two"),
        F.element_at("a", "k").alias("k"),
        F.map_contains_key("a", "k").alias("has_k"),
        templates.get_arg(C("c"), F.lit("1")).alias("got"),
    )
)
_column(
    "arg_resolve",
    "nation",
    "n_nationkey",
    lambda: templates.resolve_arg(
        F.when(C("n_nationkey") % 3 == 0, C("n_name")),
        templates.arg_reference(F.when(C("n_nationkey") % 3 == 1, "x|dflt").otherwise("x|"))["dflt"],
    ),
    "case n_nationkey % 3 when 0 then n_name when 1 then 'dflt' else '' end",
)
_column(
    "substitute_args",
    "part",
    "p_partkey",
    lambda: templates.substitute_args(
        F.lit("<{{{1}}}:{{{no|{{{b}}}}}}{{!}}{{{c|}}}>"),
        F.create_map(F.lit("1"), C("p_name"), F.lit("b"), C("p_brand")),
    ),
    "'<' || p_name || ':' || p_brand || '|>'",
)
_column(
    "noinclude",
    "part",
    "p_partkey",
    lambda: templates.without_noinclude(
        F.concat(C("p_name"), F.lit("<noinclude>"), C("p_type"), F.lit("</noinclude>"), C("p_brand"))
    ),
    "p_name || p_brand",
)
_column(
    "includeonly",
    "part",
    "p_partkey",
    lambda: templates.without_includeonly_tags(
        F.concat(F.lit("<includeonly>"), C("p_name"), F.lit("</includeonly>"), C("p_brand"))
    ),
    "p_name || p_brand",
)
_column(
    "onlyinclude",
    "part",
    "p_partkey",
    lambda: templates.only_onlyinclude(
        F.concat(
            F.lit("a<onlyinclude>"),
            C("p_name"),
            F.lit("</onlyinclude>b<onlyinclude>"),
            C("p_brand"),
            F.lit("</onlyinclude>c"),
        )
    ),
    "p_name || p_brand",
)
_column(
    "pf_if",
    "orders",
    "o_orderkey",
    lambda: templates.pf_if(F.when(C("o_orderstatus") == "O", " ").otherwise("x"), C("o_orderpriority"), F.lit("none")),
    "case when o_orderstatus = 'O' then 'none' else o_orderpriority end",
)
_column(
    "pf_ifeq",
    "orders",
    "o_orderkey",
    lambda: templates.pf_ifeq(
        F.concat(F.lit(" "), C("o_orderstatus")),
        F.lit("F "),
        F.lit("same"),
        F.lit(None).cast("string"),
    ),
    "case when o_orderstatus = 'F' then 'same' else '' end",
)
_column(
    "pf_switch",
    "orders",
    "o_orderkey",
    lambda: templates.pf_switch(C("o_orderstatus"), F.array(*map(F.lit, ("F = filled", "O=open", "other")))),
    "case o_orderstatus when 'F' then 'filled' when 'O' then 'open' else 'other' end",
)
query(
    "pf_expr",
    "select distinct l_orderkey, l_linenumber, ((l_quantity::bigint + l_linenumber) * 3 - -l_linenumber)::varchar "
    "as out from lineitem",
)(
    lambda s, d: read(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        templates.pf_expr(
            F.concat(
                F.lit("("),
                C("l_quantity").cast("long"),
                F.lit(" + "),
                "l_linenumber",
                F.lit(") * 3 - -"),
                "l_linenumber",
            )
        ).alias("out"),
    ).distinct()
)
_column(
    "pf_expr_division",
    "part",
    "p_partkey",
    lambda: templates.pf_expr(F.concat(C("p_size").cast("string"), F.lit(" / "), (C("p_partkey") % 3).cast("string"))),
    "case when p_partkey % 3 = 0 then '<strong class=\"error\">Expression error: Division by zero</strong>' when "
    "p_size % (p_partkey % 3) = 0 then (p_size // (p_partkey % 3))::varchar else (p_size // 2)::varchar || '.5' end",
)
_column(
    "pf_ifexpr",
    "part",
    "p_partkey",
    lambda: templates.pf_ifexpr(
        templates.pf_expr(F.concat(C("p_size").cast("string"), F.lit("% 2"))),
        F.lit("odd"),
        F.lit("even"),
    ),
    "case when p_size % 2 = 1 then 'odd' else 'even' end",
)
_column(
    "pf_iferror",
    "part",
    "p_partkey",
    lambda: templates.pf_iferror(
        templates.pf_expr(F.concat(F.lit("1/"), (C("p_partkey") % 2).cast("string"))),
        F.lit("bad"),
        F.lit(None).cast("string"),
    ),
    "case when p_partkey % 2 = 0 then 'bad' else '1' end",
)
_column(
    "pf_tag",
    "part",
    "p_partkey",
    lambda: templates.pf_tag(F.lit(" ref "), C("p_name"), F.create_map(F.lit("name"), C("p_brand"))),
    "'<ref name=\"' || p_brand || '\">' || p_name || '</ref>'",
)
_column(
    "pf_titleparts",
    "part",
    "p_partkey",
    lambda: templates.pf_titleparts(F.concat_ws("/", F.lit("a"), "p_brand", "p_name", F.lit("d")), F.lit(2), F.lit(2)),
    "p_brand || '/' || p_name",
)
query(
    "pf_ifexist",
    "select n_nationkey, exists (select 1 from region where r_name = n_name or r_regionkey = n_nationkey) as found "
    "from nation",
)(
    lambda s, d: read(s, d, "nation").join(
        read(s, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.lit(True).alias("found")),
        "n_nationkey",
        "left",
    ).select("n_nationkey", F.coalesce("found", F.lit(False)).alias("found"))
)
query(
    "variables",
    "select column0 as name, column1 as out from (values ('PAGENAME', 'TestPage'), ('sitename', 'Wikipedia'), "
    "('CURRENTYEAR', '2026'), ('CURRENTTIME', '{{CURRENTTIME}}'), ('Other', null)) v(column0, column1)",
)(
    lambda s, d: s.createDataFrame(
        [("PAGENAME",), ("sitename",), ("CURRENTYEAR",), ("CURRENTTIME",), ("Other",)],
        "name string",
    ).select("name", templates.variable(C("name"), now=F.to_timestamp(F.lit("2026-07-31"))).alias("out"))
)
_mw = lambda: F.concat(
    F.lit('{"parts":["x",{"template":{"target":{"wt":"'),
    C("n_name"),
    F.lit('"},"params":{"b":{"wt":"2"},"a":{"wt":"1"}}}}]}'),
)
_column(
    "json_template",
    "nation",
    "n_nationkey",
    lambda: templates.template_markup(_mw()),
    "'{{' || n_name || '|a=1|b=2}}'",
)
_column(
    "json_extension",
    "nation",
    "n_nationkey",
    lambda: templates.extension_markup(
        F.concat(
            F.lit('{"name":"ref","attrs":{"name":"'),
            C("n_name"),
            F.lit('"}'),
            F.when(C("n_nationkey") % 2 == 0, ',"body":{"extsrc":"s"}').otherwise(""),
            F.lit("}"),
        )
    ),
    "'<ref name=\"' || n_name || case when n_nationkey % 2 = 0 then '\">s</ref>' else '\"/>' end",
)
query(
    "source_range",
    "select n_nationkey, case when n_nationkey % 3 <> 0 then n_nationkey::bigint + 2 end as s, case when "
    "n_nationkey % 3 <> 0 then 99::bigint end as e from nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        templates.content_range(
            templates.source_range(
                F.concat(
                    F.lit('{"dsr":['),
                    C("n_nationkey"),
                    F.lit(",100,2"),
                    F.when(C("n_nationkey") % 3 == 0, "").otherwise(",1"),
                    F.lit("]}"),
                )
            )
        ).alias("r"),
    ).select("n_nationkey", "r.s", "r.e")
)
query("json_property", "select event_id, (props::json ->> 'k')::bigint as k from events")(
    lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
)
