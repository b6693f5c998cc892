"""Queries over rows with null and repeated keys, deep nesting, node tables, lookups and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates, text, titles
from ..operators import blocks, diff, expand, html, tokens
from ..operators.rows import spread
from ..sources import fixtures, lookups
from .strings import query, read

C, L = F.col, F.lit
NL = "chr(10)"


def _docs(s: SparkSession, d: str, make) -> DataFrame:
    """Documents a third of which have no id and a third of which share one, with a text made from the row."""
    key = F.when(C("doc_id") % 3 == 1, 7).when(C("doc_id") % 3 == 2, C("doc_id"))
    return read(s, d, "documents").select(key.cast("long").alias("doc_id"), make.alias("text"), L("x").alias("line"), L("y").alias("kind"))


_KEY = "(case doc_id % 3 when 1 then 7 when 2 then doc_id end)::bigint as doc_id"

# ---------------------------------------------------------------- rows with null and repeated keys
query(
    "rows_wt2html",
    f"select {_KEY}, '<p><i>' || source || '</i></p>' || {NL} || '<ul><li>' || lang || '</li></ul>' as html from "
    f"documents",
)(lambda s, d: blocks.wt2html(_docs(s, d, F.concat(L("''"), "source", L("''\n\n* "), "lang"))))
query(
    "rows_tokens",
    f"select {_KEY}, count(*) as texts, 2 * count(*) as quotes, count(*) as ends from documents group by 1",
)(
    lambda s, d: tokens.tokens(_docs(s, d, F.concat(L("''"), "source", L("''")))).groupBy("doc_id").agg(
        *(F.count_if(C("kind") == k).alias(n) for k, n in (("Text", "texts"), ("Quote", "quotes"), ("EOF", "ends")))
    )
)
query("rows_headings", f"select {_KEY}, 2 as line, 3 as level, source as title from documents")(
    lambda s, d: blocks.headings(_docs(s, d, F.concat(L("a\n\n=== "), "source", L(" ==="))))
)
query(
    "rows_expand",
    f"select {_KEY}, '<' || source || '> ' || lang || ' {{' || lang || '}}' as expanded from documents",
)(
    lambda s, d: expand.expand_templates(
        _docs(s, d, F.concat(L("{{T|"), "source", L("}} {{#if: x | "), "lang", L(" }} {"), "lang", L("}"))),
        s.createDataFrame([("T", "<{{{1}}}>"), (None, "no"), ("T", "~")], "title string, content string"),
    )
)
query(
    "rows_selser",
    f"select {_KEY}, 'a ' || source || case when lang = 'en' then ' b' else '' end as wikitext, 0::bigint as ignored "
    f"from documents",
)(
    lambda s, d: diff.selser(
        read(s, d, "documents").select(
            F.when(C("doc_id") % 3 == 1, 7).when(C("doc_id") % 3 == 2, C("doc_id")).cast("long").alias("doc_id"),
            F.concat(L("a "), "source").alias("wikitext"),
            F.concat(L("<p>"), "source", L("</p>")).alias("html0"),
            F.concat(L("<p>"), "source", F.when(C("lang") == "en", " b").otherwise(""), L("</p>")).alias("html1"),
        ),
        "doc_id",
    )
)

# ---------------------------------------------------------------- nesting
_depth = lambda: C("p_partkey") % 8 + 1
_part = lambda s, d, make: read(s, d, "part").select(C("p_partkey").alias("doc_id"), make.alias("text"))
_nested = lambda: F.concat(
    F.repeat(L("{{a|"), _depth().cast("int")),
    C("p_name"),
    F.repeat(L("}}"), _depth().cast("int")),
)
query(
    "nested_calls",
    "select p_partkey as doc_id, k.kind, case k.kind when 'TemplateOpen' then repeat('{{a|', d) || p_name || "
    "repeat('}}', d) when 'Text' then ' ' || p_brand end as lex "
    "from (select *, (p_partkey % 8 + 1)::int as d from part) cross join (values ('TemplateOpen'), ('Text')) k(kind)",
)(
    lambda s, d: tokens.tokens(
        _part(s, d, F.concat(_nested(), L(" "), "p_brand"))
    ).where("kind <> 'EOF'").select("doc_id", "kind", "lex")
)
query(
    "nested_arguments",
    "select p_partkey, '<' || case when p_partkey % 2 = 0 then p_name else p_brand end || '>' as out from part",
)(
    lambda s, d: read(s, d, "part").select(
        "p_partkey",
        templates.substitute_args(
            F.concat(
                L("<"),
                F.repeat(L("{{{no|"), _depth().cast("int")),
                L("{{{x|"),
                "p_brand",
                L("}}}"),
                F.repeat(L("}}}"), _depth().cast("int")),
                L(">"),
            ),
            F.when(_depth() % 2 == 1, F.create_map(L("x"), C("p_name"))).otherwise(F.create_map(L("y"), C("p_type"))),
        ).alias("out"),
    )
)
query(
    "argument_default_calls",
    "select p_partkey as doc_id, '[' || case when p_partkey % 2 = 0 then p_brand else p_name end || ']' as expanded "
    "from part",
)(
    lambda s, d: expand.expand_templates(
        _part(
            s,
            d,
            F.concat(
                L("{{T|"),
                F.when(C("p_partkey") % 2 == 0, L("x=")).otherwise("y="),
                "p_brand",
                L("|z="),
                "p_name",
                L("}}"),
            ),
        ),
        s.createDataFrame([("T", "[{{{x|{{U|{{{z}}}}}}}}]"), ("U", "{{{1}}}")], "title string, content string"),
    )
)
query("unclosed_braces", "select p_partkey as doc_id, 2::bigint as texts, 1::bigint as calls from part")(
    lambda s, d: tokens.tokens(_part(s, d, F.concat(L("{{ "), "p_name", L(" {{x}} }")))).groupBy("doc_id").agg(
        F.count_if(C("kind") == "Text").alias("texts"),
        F.count_if(C("kind") == "TemplateOpen").alias("calls"),
    )
)
query(
    "private_use_signs",
    f"select p_partkey as doc_id, '<p>' || chr(57344) || '1 ' || p_name || chr(57345) || chr(57344) || ' ''</p>' as "
    f"html, chr(57344) || '5' || p_name || ' y' as expanded from part",
)(
    lambda s, d: blocks.wt2html(_part(s, d, F.concat(L("1 "), "p_name", L(" <nowiki>'</nowiki>")))).join(
        expand.expand_templates(
            _part(s, d, F.concat(L("5"), "p_name", L(" {{T}}"))),
            s.createDataFrame([("T", "y")], "title string, content string"),
        ),
        "doc_id",
    )
)
query(
    "expanded_token_kinds",
    "select p_partkey as doc_id, kind, n::bigint as n from part cross join (values ('WikilinkOpen', 1), ('Text', "
    "1), ('WikilinkClose', 1), ('EOF', 1)) v(kind, n)",
)(
    lambda s, d: tokens.kind_counts(
        expand.expanded_tokens(
            _part(s, d, F.concat(L("{{T|"), "p_name", L("}}"))),
            s.createDataFrame([("T", "[[{{{1}}}]]")], "title string, content string"),
        )
    )
)
query("unknown_functions", "select n_nationkey as doc_id, n_name || '{{#nope|...}}' as expanded from nation")(
    lambda s, d: expand.expand_templates(
        read(s, d, "nation").select(
            C("n_nationkey").alias("doc_id"),
            F.concat("n_name", L("{{#nope:a|b}}")).alias("text"),
        ),
        s.createDataFrame([], "title string, content string"),
    )
)
query(
    "existing_pages",
    "select n_nationkey as doc_id, case when n_name in (select r_name from region) or n_nationkey < 5 then 'yes' "
    "else 'no' end as expanded from nation",
)(
    lambda s, d: expand.expand_templates(
        read(s, d, "nation").select(
            C("n_nationkey").alias("doc_id"),
            F.concat(L("{{#ifexist: P"), "n_nationkey", L(" | yes | no}}")).alias("text"),
        ),
        s.createDataFrame([], "title string, content string"),
        pages=read(s, d, "region").select(F.concat(L("P"), "r_regionkey").alias("title")),
    )
)

# ---------------------------------------------------------------- tokens of every kind
_TABLE_LINES = "\n{| class=x\n|+ cap\n|-\n! h !! i\n| c || d\n|}\n"
query(
    "token_payloads",
    "select p_partkey as doc_id, kind, case x when 'n' then p_name when 't' then '''''' || p_type "
    "when 'b' then '[[' || p_brand || ']]' when 'a' then p_brand else x end as s, n::bigint as n "
    "from part cross join (values ('Redirect', 'n', 1), ('TableOpen', null, 1), ('TableCaption', null, 1), "
    "('TableRow', null, 1), ('TableCell', null, 4), ('TableClose', null, 1), ('Pre', 't', 1), ('NowikiContent', 'b', 1), "
    "('NowikiContent', '', 1), ('TplArgOpen', 'a', 1), ('ParserFnOpen', '#if', 1), ('MagicWord', 'NOTOC', 1), "
    "('HtmlTagOpen', 'div', 1), ('HtmlTagClose', 'div', 1)) v(kind, x, n)",
)(
    lambda s, d: tokens.tokens(
        _part(s, d, F.concat(
            L("#REDIRECT [["), "p_name", L("]]"), L(_TABLE_LINES), L("<pre a>''"), "p_type",
            L("</pre><nowiki>[["), "p_brand", L("]]</nowiki><nowiki/>{{{"), "p_brand", L("|d}}}{{#if: x|"),
            "p_name", L('}}__NOTOC__<div title="a>b">y</div>'),
        ))
    ).where(~C("kind").isin("Text", "Newline", "EOF")).groupBy("doc_id", "kind", "s").agg(F.count(L(1)).alias("n"))
)
query(
    "tag_attributes",
    "select p_partkey, 'k=v;b=x > y;c=' || p_name || ';d=;title=' || p_brand as out from part",
)(
    lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(F.transform(
        tokens.parse_attributes(F.concat(
            L("<a k=v B=\"x > y\" c='"), "p_name", L("' d title = '"), "p_brand", L("'/>")
        )),
        lambda a: F.concat(a["k"], L("="), a["v"]),
    ), ";").alias("out"))
)
_mixed = lambda: F.concat(
    L("== "), "p_name", L(" ==\n* '''''"), "p_brand", L("'' [http://x y] [[["), "p_type", L("]]] {{a|{{{b}}}| }} <!-- ")
)
query(
    "lexemes_rebuild_text",
    "select p_partkey as doc_id, true as same from part",
)(
    lambda s, d: tokens.tokens(_part(s, d, _mixed()))
    .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "lex"))).alias("t"))
    .join(_part(s, d, _mixed()), "doc_id")
    .select("doc_id", (F.array_join(F.transform("t", lambda x: x["lex"]), "") == C("text")).alias("same"))
)
query(
    "verbatim_html",
    "select p_partkey as doc_id, '<p>[[' || p_brand || ']] ''''x''''</p>' as html from part",
)(
    lambda s, d: blocks.wt2html(
        _part(s, d, F.concat(L("<nowiki>[["), "p_brand", L("]]</nowiki> <nowiki>''x''</nowiki>")))
    )
)

# ---------------------------------------------------------------- node tables
query(
    "markup_nodes",
    "select p_partkey as doc_id, path, node_kind, elem_kind, case x when 'b' then p_brand when 'n' then p_name when "
    "'t' then ' [__TOC__]' when 'y' then p_type else x end as text from part cross join (values "
    "('/00000', 'Element', 'Heading', null), ('/00000/00000', 'Text', null, 'b'), ('/00002', 'Element', "
    "'Paragraph', null), ('/00002/00000', 'Element', 'Bold', null), "
    "('/00002/00000/00000', 'Text', null, 'n'), ('/00002/00001', 'Text', null, 't'), ('/00004', 'Element', "
    "'UnorderedList', null), ('/00004/00000', 'Element', 'ListItem', null), "
    "('/00004/00000/00000', 'Text', null, 'y')) v(path, node_kind, elem_kind, x)",
)(
    lambda s, d: html.wt_nodes(
        _part(
            s,
            d,
            F.concat(L("== "), "p_brand", L(" ==\n'''"), "p_name", L("''' __TOC__{{T|x}}\n* "), "p_type", L("{{{a}}}")),
        )
    ).where("node_kind <> 'Text' or trim(text, '\n') <> ''").select("doc_id", "path", "node_kind", "elem_kind", "text")
)
_snippet = lambda: F.concat(
    L('<h2>'),
    "p_brand",
    L('</h2><p>a <b>'),
    "p_name",
    L('</b><br/>&amp; b</p><ul><li class="x">'),
    "p_type",
    L("</li></ul><!-- c -->"),
)
query(
    "nodes_to_html",
    "select p_partkey as doc_id, '<h2>' || p_brand || '</h2><p>a <b>' || p_name || '</b><br/>&amp; b</p><ul><li "
    "class=\"x\">' || p_type || '</li></ul><!-- c -->' as html from part",
)(
    lambda s, d: html.nodes_to_html(
        html.html_nodes(_part(s, d, _snippet()), "doc_id", "text"),
        "doc_id",
    ).select("doc_id", "html")
)
query(
    "nodes_to_markup",
    f"select p_partkey as doc_id, '==' || p_brand || '==' || {NL} || 'a ''''''' || p_name || '''''''<br/>' || {NL} "
    f"|| '& b' || {NL} || '* ' || p_type || {NL} || '<!-- c -->' as wikitext from part",
)(
    lambda s, d: html.nodes_to_markup(
        html.html_nodes(_part(s, d, _snippet()), "doc_id", "text"),
        "doc_id",
    ).select("doc_id", "wikitext")
)
query(
    "nodes_to_html_indented",
    "select p_partkey as doc_id, '<div>  <p>a &lt; ' || p_name || '</p>  <pre>x < ' || p_brand || '</pre></div>' "
    "as html from part",
)(
    lambda s, d: html.nodes_to_html(
        html.html_nodes(
            _part(s, d, F.concat(
                L("<div><p>a &lt; "), "p_name", L("</p><pre>x &lt; "), "p_brand", L("</pre></div>")
            )), "doc_id", "text",
        ), "doc_id", indent=True,
    ).select("doc_id", "html")
)
query(
    "nodes_json",
    "select p_partkey as doc_id, '{\"node_kind\":\"Text\",\"path\":\"/00000/00000\",\"text\":\"' || p_name || '\"}' "
    "as json from part",
)(
    lambda s, d: html.html_nodes(
        _part(s, d, F.concat(L("<p>"), "p_name", L("</p>"))),
        "doc_id",
        "text",
    ).where("node_kind = 'Text'").select("doc_id", html.node_json("node_kind", "path", "text").alias("json"))
)
query(
    "node_sequence",
    "select page_id, count(*) as n, true as ordered from (select page_id, unnest(regexp_extract_all(html, '<h1>')) "
    "from pages) group by page_id",
)(
    lambda s, d: html.html_nodes(read(s, d, "pages")).groupBy("page_id").agg(
        F.count_if(C("tag") == "h1").alias("n"),
        F.bool_and((C("parent_id") < C("node_id")) & (C("until") >= C("node_id"))).alias("ordered"),
    )
)

# ---------------------------------------------------------------- markup from HTML
_wt = lambda s, d, make: spread(read(s, d, "part"), "p_partkey").select("p_partkey", html.html2wt(make).alias("out"))
query(
    "html2wt_nested_lists",
    f"select p_partkey, '* ' || p_brand || {NL} || '** ' || p_name || {NL} || '### ' || p_type || {NL} || '* x' || "
    f"{NL} as out from part",
)(
    lambda s, d: _wt(
        s,
        d,
        F.concat(
            L("<ul><li>"),
            "p_brand",
            L("<ul><li>"),
            "p_name",
            L("<ol><li>"),
            "p_type",
            L("</li></ol></li></ul></li><li>x</li></ul>"),
        ),
    )
)
query(
    "html2wt_tables",
    f"select p_partkey, "
    f"'{{| class=\"x\"' || {NL} || '|+ ' || p_brand || {NL} || '|-' || {NL} || '!' || p_name || {NL} || '|' || p_type || {NL} || '|}}' "
    f"|| {NL} as out from part",
)(
    lambda s, d: _wt(
        s,
        d,
        F.concat(
            L('<table class="x">\n<caption>'),
            "p_brand",
            L("</caption><tbody><tr><th>"),
            "p_name",
            L("<td>"),
            "p_type",
            L("</tr></tbody>\n</table>"),
        ),
    )
)
query(
    "html2wt_other",
    f"select p_partkey, '<pre>' || p_name || '</pre>' || {NL} || '[[' || p_brand || ']]<!-- ' || p_type || ' --><div "
    f"id=\"a\">x</div>' || {NL} || '<kbd>y</kbd>' as out from part",
)(
    lambda s, d: _wt(
        s,
        d,
        F.concat(
            L("<pre>"),
            "p_name",
            L('</pre><img src="'),
            "p_brand",
            L('"><!-- '),
            "p_type",
            L(' --><div id="a">x</div><kbd>y</kbd>'),
        ),
    )
)
query(
    "html2wt_rebuilt",
    "select p_partkey, 'a {{' || p_brand || '|k=' || p_name || '}} <ref name=\"' || p_brand || '\">' || p_type || "
    "'</ref>' as out from part",
)(
    lambda s, d: _wt(
        s,
        d,
        F.concat(
            L('a <span typeof="mw:Transclusion" data-mw=\'{"parts":[{"template":{"target":{"wt":"'),
            "p_brand",
            L('"},"params":{"k":{"wt":"'),
            "p_name",
            L('"}}}}]}\'>shown <b>text</b></span> '),
            L('<sup typeof="mw:Extension/ref" data-mw=\'{"name":"ref","attrs":{"name":"'),
            "p_brand",
            L('"},"body":{"extsrc":"'),
            "p_type",
            L('"}}\'>[1]</sup>'),
        ),
    )
)
query("html_references", "select p_partkey, 'é A & ' || p_name || ' “' as out from part")(
    lambda s, d: _wt(s, d, F.concat(L("&eacute; &#x41; &amp; "), "p_name", L(" &#8220;")))
)
query(
    "element_writers",
    "select n_nationkey, '<figure-inline><img src=\"' || n_name || '\"/></figure-inline><x></x>' as out from nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        F.concat(html.image_html(C("n_name")), text.html_create(L("x"))).alias("out"),
    )
)

# ---------------------------------------------------------------- differences
query(
    "change_kinds",
    "select n_nationkey as page_id, case n_nationkey % 5 when 0 then 'Inserted' when 1 then 'Deleted' when 2 then "
    "'ChildrenModified' when 3 then 'AttrsModified' else 'TextModified' end as change, "
    "case n_nationkey % 5 when 4 then '/00000/00000' when 0 then '/00001' when 1 then '/00001' else '/00000' end as "
    "path from nation",
)(
    lambda s, d: diff.diff_pages(
        read(s, d, "nation").select(
            C("n_nationkey").alias("page_id"),
            F.concat(
                L("<p id=a>"),
                "n_name",
                L("</p>"),
                F.when(C("n_nationkey") % 5 == 1, "<ul><li>x</li></ul>").otherwise(""),
            ).alias("html0"),
            F.when(
                C("n_nationkey") % 5 == 0,
                F.concat(L("<p id=a>"), "n_name", L("</p><div><i>x</i></div>")),
            ).when(C("n_nationkey") % 5 == 1, F.concat(L("<p id=a>"), "n_name", L("</p>"))).when(
                C("n_nationkey") % 5 == 2,
                F.concat(L("<div id=a>"), "n_name", L(" new</div>")),
            ).when(
                C("n_nationkey") % 5 == 3,
                F.concat(L("<p id=b>"), "n_name", L("</p>")),
            ).otherwise(L("<p id=a>changed</p>")).alias("html1"),
        )
    ).select("page_id", "change", "path")
)
query(
    "selser_inserts",
    f"select n_nationkey as page_id, n_name || {NL} || '* ''''x''''' || {NL} || '* [[y]]' as wikitext, 0::bigint as "
    f"ignored from nation",
)(
    lambda s, d: diff.selser(
        read(s, d, "nation").select(
            C("n_nationkey").alias("page_id"),
            C("n_name").alias("wikitext"),
            F.concat(L("<p>"), "n_name", L("</p>")).alias("html0"),
            F.concat(L("<p>"), "n_name", L('</p><ul><li><i>x</i></li><li><a href="y">y</a></li></ul>')).alias("html1"),
        )
    ).select("page_id", F.rtrim(F.regexp_replace("wikitext", r"\n\z", "")).alias("wikitext"), "ignored")
)
query(
    "merged_regions",
    "with r as (select n_regionkey as page_id, (n_nationkey * 7 % 40)::bigint as s, (n_nationkey * 7 % 40 + 1 + "
    "n_nationkey % 9)::bigint as e from nation), "
    "f as (select *, case when s > max(e) over (partition by page_id order by s, e rows between unbounded preceding "
    "and 1 preceding) then 1 else 0 end as fresh from r), "
    "g as (select *, sum(fresh) over (partition by page_id order by s, e rows unbounded preceding) as island from "
    "f) "
    "select page_id, min(s) as s, max(e) as e from g group by page_id, island",
)(
    lambda s, d: diff.source_regions(
        read(s, d, "nation").select(
            C("n_regionkey").alias("page_id"),
            F.concat(
                L('{"dsr":['),
                (C("n_nationkey") * 7 % 40).cast("string"),
                L(","),
                (C("n_nationkey") * 7 % 40 + 1 + C("n_nationkey") % 9).cast("string"),
                L(",0,0]}"),
            ).alias("data_parsoid"),
        )
    )
)

# ---------------------------------------------------------------- lookups, variables, test cases
_content = lambda s, d: lookups.in_memory(
    s,
    modules=[("Module:M1", "one"), ("Module:M2", "two")],
    files=[("File:F1", "image/png", 5, 640, 480, "d", "u", {})],
    pages=[("MediaWiki:k1", "message"), ("Template:T1", "t")],
)
query(
    "module_lookup",
    "select n_nationkey, 'M' || n_nationkey as name, case n_nationkey when 1 then 'one' when 2 then 'two' end as "
    "content from nation",
)(
    lambda s, d: lookups.modules(
        read(s, d, "nation").select("n_nationkey", F.concat(L("M"), "n_nationkey").alias("name")),
        _content(s, d),
    )
)
query(
    "file_lookup",
    "select n_nationkey, 'File:F' || n_nationkey as title, case n_nationkey when 1 then 640 end as width from nation",
)(
    lambda s, d: lookups.files(
        read(s, d, "nation").select("n_nationkey", F.concat(L("File:F"), "n_nationkey").alias("title")),
        _content(s, d),
    ).select("n_nationkey", "title", C("file.width").alias("width"))
)
query(
    "page_messages",
    "select 'k' || n_nationkey as key, case n_nationkey when 1 then 'message' else 'k' || n_nationkey end as value "
    "from nation",
)(
    lambda s, d: lookups.page_messages(
        read(s, d, "nation").select(F.concat(L("k"), "n_nationkey").alias("key")),
        _content(s, d),
    )
)
query(
    "template_lookup",
    "select 'T' || n_nationkey as name, case n_nationkey when 1 then 't' end as content from nation",
)(
    lambda s, d: lookups.prefixed_lookup(
        read(s, d, "nation").select(F.concat(L("T"), "n_nationkey").alias("name")),
        _content(s, d).pages,
        "Template",
        10,
    )
)
query("date_variables", "select event_id, strftime(ts, '%Y-%m-%d') as day, (day(ts))::varchar as short from events")(
    lambda s, d: read(s, d, "events").select(
        "event_id",
        F.concat_ws(
            "-",
            *(templates.variable(L(n), now=C("ts")) for n in ("CURRENTYEAR", "CURRENTMONTH", "CURRENTDAY2")),
        ).alias("day"),
        templates.variable(L("CurrentDay"), now=C("ts")).alias("short"),
    )
)
query(
    "current_titles",
    "select n_nationkey, 'Help' as ns_text, n_name as text, 'Help:' || n_name as full_text from nation",
)(
    lambda s, d: titles.with_current_title(
        read(s, d, "nation").select("n_nationkey", F.concat(L("help:"), "n_name").alias("title")),
        "title",
    ).select("n_nationkey", "page.ns_text", "page.text", "page.full_text")
)
query(
    "case_modes",
    "select n_nationkey, case n_nationkey % 4 when 0 then 'wt2html' when 1 then 'wt2html' when 2 then 'selser' else "
    "'skip' end as mode from nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        fixtures.mode_of(
            F.when(C("n_nationkey") % 4 == 0, L('{"a": 1}')).when(
                C("n_nationkey") % 4 == 1,
                "parsoid=wt2html",
            ).otherwise("parsoid=html2wt"),
            C("n_nationkey") % 4 < 2,
            C("n_nationkey") % 4 == 2,
        ).alias("mode"),
    )
)
query(
    "result_lines",
    "select n_nationkey, case n_nationkey % 2 when 0 then 'PASS' else 'FAIL (' || n_name || ')' end as line from "
    "nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        fixtures.result_line(F.when(C("n_nationkey") % 2 == 0, "PASS").otherwise("FAIL"), C("n_name")).alias("line"),
    )
)
query(
    "summary_lines",
    f"select o_orderpriority as path, 'Results: ' || count(*) filter (o_orderstatus = 'F') || '/' || count(*) || ' "
    f"passed' || {NL} || '  Failed:  ' || count(*) filter (o_orderstatus = 'O') || {NL} || '  Skipped: ' || count(*) "
    f"filter (o_orderstatus = 'P') || {NL} || '  Errors:  0' as lines from orders group by 1",
)(
    lambda s, d: fixtures.summary(
        read(s, d, "orders").select(
            C("o_orderpriority").alias("path"),
            F.when(
                C("o_orderstatus") == "F",
                "PASS",
            ).when(C("o_orderstatus") == "O", "FAIL").otherwise("SKIP").alias("status"),
        )
    ).where("path is not null").select("path", fixtures.summary_line().alias("lines"))
)
