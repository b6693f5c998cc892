"""Queries of the corpus operators: tokens, blocks, HTML, diffs, expansion, lookups, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import site, text, titles
from ..functions.registry import ExtensionTags, is_transient
from ..operators import blocks, diff, expand, html, tokens
from ..operators.rows import spread
from ..sources import fixtures, lookups
from .strings import query, read

C = F.col


def _built(spark: SparkSession, d: str, table: str, key: str, make) -> DataFrame:
    """Markup made from a row's columns; the same columns tell what the operators must find."""
    return read(spark, d, table).select(F.col(key).alias("doc_id"), make.alias("text"))


def _parts(s, d):
    made = F.concat(
        F.lit("== "), "p_brand", F.lit(" ==\n''"), "p_name", F.lit("'' and '''"), "p_type",
        F.lit("'''\n----\n* [["), "p_brand", F.lit("|"), "p_name", F.lit("]]\n* {{T|x={{U}}}} <br/>\n<!-- "),
        "p_type", F.lit(" --> [http://x.y/"), "p_size", F.lit(" z]"),
    )
    return _built(s, d, "part", "p_partkey", made)


_KINDS = (
    "select doc_id, kind, n from (select p_partkey as doc_id from part) cross join (values ('HeadingOpen', 1), "
    "('Text', 11), ('Newline', 5), ('Quote', 4), ('Hr', 1), ('ListItem', 2), ('WikilinkOpen', 1), ('WikilinkPipe', 1), "
    "('WikilinkClose', 1), ('TemplateOpen', 1), ('SelfClosingTag', 1), ('Comment', 1), ('ExtLinkOpen', 1), "
    "('ExtLinkClose', 1), ('EOF', 1)) k(kind, n)"
)
query(
    "token_kinds",
    _KINDS.replace(", n from", ", n::bigint as n from"),
)(lambda s, d: tokens.kind_counts(tokens.tokens(_parts(s, d))))
query("token_lines", "select p_partkey as doc_id, 5 as last_line from part")(
    lambda s, d: tokens.tokens(_parts(s, d)).groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
)
query("token_classes", "select p_partkey as doc_id, 17::bigint as inline, 4::bigint as block from part")(
    lambda s, d: tokens.tokens(_parts(s, d)).groupBy("doc_id").agg(
        F.count_if(tokens.is_inline(C("kind"))).alias("inline"),
        F.count_if(tokens.is_block_start(C("kind"))).alias("block"),
    )
)
query("token_text_covers_input", "select p_partkey as doc_id, true as same from part")(
    lambda s, d: tokens.tokens(_parts(s, d)).groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "lex"))), lambda t: t["lex"]),
            "",
        ).alias("x")
    ).join(_parts(s, d), "doc_id").select("doc_id", (C("x") == C("text")).alias("same"))
)
query(
    "token_display",
    "select n_nationkey as doc_id, column0::int as tok_idx, replace(column1, '@', n_name) as shown from nation "
    "cross join (values (0, 'HeadingOpen(2)'), (1, 'Text(\" @ ==\")'), (2, 'Newline'), (3, 'ListItem(#, 2)'), (4, "
    "'TemplateOpen(@)'), (5, 'HtmlTagOpen(b)'), (6, 'Comment(\"@\")'), (7, 'EOF')) v(column0, column1)",
)(
    lambda s, d: tokens.tokens(
        _built(
            s,
            d,
            "nation",
            "n_nationkey",
            F.concat(
                F.lit("== "),
                "n_name",
                F.lit(" ==\n##{{"),
                "n_name",
                F.lit("|1}}<B id='x'><!--"),
                "n_name",
                F.lit("-->"),
            ),
        )
    ).select("doc_id", "tok_idx", tokens.display(C("kind"), C("s"), C("level")).alias("shown"))
)
query(
    "quote_parity",
    "select p_partkey as doc_id, 1 as line_no, 1::bigint as italic, 1::bigint as bold, true as unbalanced from part",
)(
    lambda s, d: tokens.quote_parity(
        tokens.tokens(_built(s, d, "part", "p_partkey", F.concat(F.lit("x\n''"), "p_name", F.lit(" '''"), "p_type")))
    )
)
query(
    "inline_quotes",
    "select p_partkey, case p_partkey % 6 when 0 then 'a <i>' || p_brand || '</i>' when 1 then '<b>' || p_brand || "
    "'</b> b' when 2 then '<b><i>' || p_brand || '</i></b>' when 3 then '<i><b>' || p_brand || '</b></i>' when 4 "
    "then '<i>' || p_brand || '</i>' else 'l''<i>' || p_brand || '</i>' end as out from part",
)(
    lambda s, d: read(s, d, "part").select(
        "p_partkey",
        tokens.inline_quotes(
            F.when(C("p_partkey") % 6 == 0, F.concat(F.lit("a ''"), "p_brand", F.lit("''"))).when(
                C("p_partkey") % 6 == 1,
                F.concat(F.lit("'''"), "p_brand", F.lit("''' b")),
            ).when(C("p_partkey") % 6 == 2, F.concat(F.lit("'''''"), "p_brand")).when(
                C("p_partkey") % 6 == 3,
                F.concat(F.lit("'''''"), "p_brand", F.lit("'''''")),
            ).when(
                C("p_partkey") % 6 == 4,
                F.concat(F.lit("''"), "p_brand"),
            ).otherwise(F.concat(F.lit("l'''"), "p_brand", F.lit("''")))
        ).alias("out"),
    )
)
_LINE_ORDER = ("l_linenumber", "l_quantity", "l_partkey")  # nulls come last, as in the SQL
query(
    "list_groups",
    "select l_orderkey, l_linenumber, l_quantity, sum(fresh) over (partition by l_orderkey order by l_linenumber, "
    "l_quantity, l_partkey)::int as group_no, l_partkey from (select *, case when l_returnflag is distinct from "
    "lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_quantity, l_partkey) then 1 else 0 "
    "end as fresh from lineitem)",
)(
    lambda s, d: tokens.list_groups(
        read(s, d, "lineitem").withColumn("place", F.struct(*(x for c in _LINE_ORDER for x in (C(c).isNull().alias(f"no_{c}"), C(c))))),
        "l_orderkey",
        "place",
        "l_returnflag",
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "group_no")
)
query(
    "headings",
    "select p_partkey as doc_id, 0 as line, 2 as level, p_brand as title from part",
)(lambda s, d: blocks.headings(_parts(s, d)))
query(
    "wikilinks",
    "select p_partkey as doc_id, 0 as ord, p_brand as target, p_name as display from part",
)(lambda s, d: blocks.wikilinks(_parts(s, d)))
query(
    "extlinks",
    "select p_partkey as doc_id, 0 as ord, 'http://x.y/' || p_size as url, 'z' as display from part",
)(lambda s, d: blocks.extlinks(_parts(s, d)))
query(
    "template_refs",
    "select p_partkey as doc_id, name from part cross join (values ('T'), ('U')) v(name)",
)(lambda s, d: blocks.template_refs(_parts(s, d)))
query(
    "wt2html",
    "select p_partkey as doc_id, '<h2>' || p_brand || '</h2>' || chr(10) || '<p><i>' || p_name || '</i> and <b>' || "
    "p_type || '</b></p>' || chr(10) || '<hr/>' || chr(10) || '<ul><li>one</li>' || chr(10) || '<li><a "
    "rel=\"mw:WikiLink\" href=\"./' || replace(p_brand, ' ', '_') || '\" title=\"' || p_brand || '\">' || p_name || "
    "'</a></li></ul>' || chr(10) || '<p>a &amp; &lt; b' || chr(10) || 'c</p>' || chr(10) || '<p>d</p>' as html from "
    "part",
)(
    lambda s, d: blocks.wt2html(
        _built(
            s,
            d,
            "part",
            "p_partkey",
            F.concat(
                F.lit("== "),
                "p_brand",
                F.lit(" ==\n''"),
                "p_name",
                F.lit("'' and '''"),
                "p_type",
                F.lit("'''\n----\n* one\n* [["),
                "p_brand",
                F.lit("|"),
                "p_name",
                F.lit("]]\na & < b\nc\n\nd"),
            ),
        )
    )
)
query(
    "wt_tables",
    "select n_nationkey as doc_id, '<table class=\"x\"><caption>' || n_name || "
    "'</caption><tr><th>a</th><th>b</th></tr><tr><td>' || n_nationkey || '</td><td>' || n_regionkey || "
    "'</td></tr></table>' as html from nation",
)(
    lambda s, d: blocks.wt2html(
        _built(
            s,
            d,
            "nation",
            "n_nationkey",
            F.concat(
                F.lit('{| class="x"\n|+ '),
                "n_name",
                F.lit("\n|-\n! a !! b\n|-\n| "),
                "n_nationkey",
                F.lit(" || "),
                "n_regionkey",
                F.lit("\n|}"),
            ),
        )
    )
)
query(
    "expand_templates",
    "select c_custkey as doc_id, 'x <' || n_name || ': ' || c_name || '|> yes 7 ' as expanded from customer join "
    "nation on c_nationkey = n_nationkey",
)(
    lambda s, d: expand.expand_templates(
        read(s, d, "customer").select(
            C("c_custkey").alias("doc_id"),
            F.concat(
                F.lit("x {{T"),
                "c_nationkey",
                F.lit("|"),
                "c_name",
                F.lit("}} {{#if: {{#expr: 1 + {{missing}} 0}} | yes | no }} {{#expr: 1 + 2 * 3}} {{nothing|a=b}}"),
            ).alias("text"),
        ),
        read(s, d, "nation").select(
            F.concat(F.lit("T"), "n_nationkey").alias("title"),
            F.concat(F.lit("<"), "n_name", F.lit(": {{{1}}}{{!}}><noinclude>doc</noinclude>")).alias("content"),
        ),
    )
)
query(
    "page_lookup",
    "select t.title, coalesce(p.n_name, 'tpl ' || r.r_name) as content from (select 'P' || n_nationkey as title "
    "from nation union select 'P' || (100 + r_regionkey) from region union select 'Q') t left join nation p on "
    "t.title = 'P' || p.n_nationkey left join region r on t.title = 'P' || (100 + r.r_regionkey)",
)(
    lambda s, d: lookups.page_content(
        read(s, d, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("title")).union(
            read(s, d, "region").select(F.concat(F.lit("P"), 100 + C("r_regionkey")))
        ).union(s.range(1).select(F.lit("Q"))),
        lookups.Content(
            read(s, d, "nation").select(
                F.concat(F.lit("P"), "n_nationkey").alias("title"),
                C("n_name").alias("content"),
            ),
            read(s, d, "region").select(
                F.concat(F.lit("P"), 100 + C("r_regionkey")).alias("title"),
                F.concat(F.lit("tpl "), "r_name").alias("content"),
            ),
            *[None] * 4,
        ),
    )
)
query(
    "redirect_lookup",
    "select n.n_name as title, case when n.n_nationkey % 2 = 0 then r_name end as target from nation n join region "
    "on n_regionkey = r_regionkey",
)(
    lambda s, d: lookups.resolved(
        read(s, d, "nation").select(C("n_name").alias("title")),
        lookups.Content(
            None,
            None,
            None,
            None,
            lookups.redirects_of(
                read(s, d, "nation").join(read(s, d, "region"), C("n_regionkey") == C("r_regionkey")).select(
                    C("n_name").alias("title"),
                    F.concat(
                        F.when(C("n_nationkey") % 2 == 0, "#REDIRECT [[").otherwise("[["),
                        "r_name",
                        F.lit("]]"),
                    ).alias("content"),
                )
            ),
            None,
        ),
    )
)
query(
    "message_lookup",
    "select 'en' as lang, n_name as key, case when n_nationkey % 2 = 0 then 'm' || n_nationkey else n_name end as "
    "value from nation",
)(
    lambda s, d: lookups.messages(
        read(s, d, "nation").select(F.lit("en").alias("lang"), C("n_name").alias("key")),
        lookups.Content(
            None,
            None,
            None,
            None,
            None,
            read(s, d, "nation").where("n_nationkey % 2 = 0").select(
                F.lit("en").alias("lang"),
                C("n_name").alias("key"),
                F.concat(F.lit("m"), "n_nationkey").alias("value"),
            ),
        ),
    )
)
query("cache_ttl", "select event_id from events where date_diff('second', ts, timestamp '2024-01-15 00:00:00') < 86400")(
    lambda s, d: lookups.fresh(
        read(s, d, "events").withColumn("fetched_at", C("ts")),
        F.lit("2024-01-15 00:00:00").cast("timestamp"),
        86400,
    ).select("event_id")
)
query("api_payload", "select n_nationkey, n_name as content from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        lookups.page_from_payload(
            F.concat(
                F.lit('{"query":{"pages":[{"title":"x","revisions":[{"slots":{"main":{"content":"'),
                "n_name",
                F.lit('"}}}]}]}}'),
            )
        ).alias("content"),
    )
)
query("extension_tags", "select n_nationkey, 'a [' || n_name || '] <x>b</x>' as out from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        _tags().apply(F.concat(F.lit('a <ref name="q">'), "n_name", F.lit("</ref> <x>b</x>"))).alias("out"),
    )
)
query(
    "transient_errors",
    "select column0 as code, column1 as transient from (values ('DataSource', true), ('Parse', false)) v(column0, "
    "column1)",
)(
    lambda s, d: s.createDataFrame([("DataSource",), ("Parse",)], "code string").select(
        "code",
        is_transient(C("code")).alias("transient"),
    )
)


def _tags() -> ExtensionTags:
    tags = ExtensionTags()
    tags.register("ref", lambda body, attrs: F.concat(F.lit("["), body, F.lit("]")))
    return tags


# HTML pages
query(
    "html_links",
    "select page_id, generate_subscripts(l, 1) - 1 as ord, unnest(l) as href from (select page_id, "
    "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) as l from pages)",
)(lambda s, d: html.html_links(read(s, d, "pages")).withColumn("ord", C("ord").cast("long")))
query(
    "html_comments",
    "select page_id, (generate_subscripts(l, 1) - 1)::int as ord, unnest(l) as comment from (select page_id, "
    "regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) as l from pages)",
)(lambda s, d: html.html_comments(read(s, d, "pages")))
query(
    "html_title",
    "select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title from pages",
)(lambda s, d: read(s, d, "pages").select("page_id", html.html_title(C("html")).alias("title")))
query(
    "html_body",
    "select page_id, case when contains(html, '</body>') then trim(regexp_extract(html, "
    "'(?s)<body[^>]*>(.*)</body>', 1), E' \\n\\t\\r') else trim(html, E' \\n\\t\\r') end as body from pages",
)(lambda s, d: read(s, d, "pages").select("page_id", text.body_of(C("html")).alias("body")))
query(
    "strip_comments",
    "select page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') as out from pages",
)(lambda s, d: read(s, d, "pages").select("page_id", text.strip_comments(C("html")).alias("out")))
_TAGS = "('article', 'nav', 'ul', 'li', 'a', 'h1', 'b', 'br', 'footer', 'div')"
query(
    "html_tag_counts",
    f"select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', "
    f"1)) as tag from pages) where tag in {_TAGS} group by all",
)(
    lambda s, d: html.html_tags(read(s, d, "pages")).where(
        f"not closing and tag in {_TAGS}"
    ).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "html_elements",
    "select page_id, 'Wikilink' as elem_kind, len(regexp_extract_all(html, '<a href'))::bigint as n from pages "
    "where contains(html, '<a href') union all select page_id, 'Heading', 1 from pages union all select page_id, "
    "'ListItem', len(regexp_extract_all(html, '<li>'))::bigint from pages where contains(html, '<li>')",
)(
    lambda s, d: html.html_nodes(read(s, d, "pages")).where(
        "elem_kind in ('Wikilink', 'Heading', 'ListItem')"
    ).groupBy("page_id", "elem_kind").agg(F.count(F.lit(1)).alias("n"))
)
# every tag and kind; comments and raw text, which hold no tags, are taken out in the SQL first
ALL_TAGS_SQL = (
    "regexp_extract_all(regexp_replace(regexp_replace({}, '<!--.*?-->', '', 'gs'), "
    "'(<(?:script|style|title|textarea)[^>]*>).*?</', '\\1</', 'gs'), '<([a-z][a-z0-9]*)[^>]*>', 1)"
)
query(
    "html_tag_counts_whole",
    f"select page_id, tag, count(*) as n from (select page_id, unnest({ALL_TAGS_SQL.format('html')}) as tag from "
    f"pages) group by all",
)(
    lambda s, d: html.html_tags(read(s, d, "pages")).where("not closing").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n")
    )
)
_KINDS_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(site.TAG_KINDS.items()) if k != "a")
_BODY_SQL = (
    "case when contains(html, '</body>') then regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1) else html end"
)
query(
    "html_elements_whole",
    "select page_id, case when tag = 'a' then 'Wikilink' when regexp_matches(tag, '^h[1-6]$') then 'Heading' "
    f"else case tag {_KINDS_SQL} else 'Other' end end as elem_kind, count(*) as n "
    f"from (select page_id, unnest({ALL_TAGS_SQL.format(_BODY_SQL)}) as tag from pages) group by all",
)(
    lambda s, d: html.html_nodes(read(s, d, "pages")).where("node_kind = 'Element'").groupBy("page_id", "elem_kind").agg(
        F.count(F.lit(1)).alias("n")
    )
)
query(
    "html_list_texts",
    "select page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) as text from pages",
)(
    lambda s, d: html.html_nodes(read(s, d, "pages")).alias("t").join(
        html.html_nodes(read(s, d, "pages")).where("tag = 'a'").select("page_id", C("node_id").alias("parent_id")),
        ["page_id", "parent_id"],
    ).select("page_id", "text")
)
query("html2wt_links", "select page_id, len(regexp_extract_all(html, '<a href'))::bigint as links from pages")(
    lambda s, d: read(s, d, "pages").select(
        "page_id",
        F.size(
            F.regexp_extract_all(html.html2wt(C("html")), F.lit(r"\[\[/[^\]|]*\|"), F.lit(0))
        ).cast("long").alias("links"),
    )
)
query(
    "html2wt",
    "select p_partkey, '==' || p_brand || '==' || chr(10) || '''''' || p_name || ''''' and ''''''' || p_type || "
    "'''''''' || chr(10) || '[[x|' || p_brand || ']]' || chr(10) || '* one' || chr(10) || '# two' || chr(10) || "
    "'----' as out from part",
)(
    lambda s, d: spread(read(s, d, "part"), "p_partkey").select(
        "p_partkey",
        F.trim(
            F.rtrim(
                F.regexp_replace(
                    html.html2wt(
                        F.concat(
                            F.lit("<body><h2>"),
                            "p_brand",
                            F.lit("</h2><p><i>"),
                            "p_name",
                            F.lit("</i> and <b>"),
                            "p_type",
                            F.lit('</b></p><p><a href="x">'),
                            "p_brand",
                            F.lit("</a></p><ul><li>one</li></ul><ol><li>two</li></ol><hr/></body>"),
                        )
                    ),
                    r"\n\z",
                    "",
                )
            )
        ).alias("out"),
    )
)
query(
    "round_trip",
    "select p_partkey as doc_id, '==' || p_brand || '==' || chr(10) || chr(10) || '''''' || p_name || '''''' as out "
    "from part",
)(
    lambda s, d: blocks.wt2html(
        _built(s, d, "part", "p_partkey", F.concat(F.lit("== "), "p_brand", F.lit(" ==\n''"), "p_name", F.lit("''")))
    ).select("doc_id", F.regexp_replace(html.html2wt(C("html")), r"\n\z", "").alias("out"))
)
query(
    "node_diff",
    "select page_id, 'TextModified' as change, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) is not null as "
    "known from pages where contains(html, '<h1>')",
)(
    lambda s, d: diff.diff_pages(
        read(s, d, "pages").select(
            "page_id",
            C("html").alias("html0"),
            F.replace("html", F.lit("<h1>"), F.lit("<h1>edited ")).alias("html1"),
        )
    ).select("page_id", "change", F.col("old_text").isNotNull().alias("known"))
)
query(
    "selser",
    "select n_nationkey as page_id, case when n_nationkey % 2 = 0 then 'a ' || n_name || ' b' else 'a new ' || "
    "n_name || ' b' end as wikitext, 0::bigint as ignored from nation",
)(
    lambda s, d: diff.selser(
        read(s, d, "nation").select(
            C("n_nationkey").alias("page_id"),
            F.concat(F.lit("a "), "n_name", F.lit(" b")).alias("wikitext"),
            F.concat(F.lit("<body><p>"), "n_name", F.lit("</p></body>")).alias("html0"),
            F.concat(
                F.lit("<body><p>"),
                F.when(C("n_nationkey") % 2 == 0, "").otherwise("new "),
                "n_name",
                F.lit("</p></body>"),
            ).alias("html1"),
        )
    )
)
query("source_regions", "select n_regionkey as page_id, 0::bigint as s, 25::bigint as e from nation group by 1")(
    lambda s, d: diff.source_regions(
        read(s, d, "nation").select(
            C("n_regionkey").alias("page_id"),
            F.concat(
                F.lit('{"dsr":['),
                F.pmod(C("n_nationkey") * 7, F.lit(20)) * 0,
                F.lit(","),
                20 + C("n_nationkey") * 0 + 5,
                F.lit(",0,0]}"),
            ).alias("data_parsoid"),
        ).distinct()
    )
)
query(
    "test_summary",
    "select o_orderpriority as path, count(*) as total, count(*) filter (o_orderstatus = 'F') as passed, count(*) "
    "filter (o_orderstatus = 'O') as failed, count(*) filter (o_orderstatus = 'P') as skipped, 0::bigint as errors "
    "from orders group by rollup (o_orderpriority)",
)(
    lambda s, d: fixtures.summary(
        read(s, d, "orders").select(
            C("o_orderpriority").alias("path"),
            F.when(
                C("o_orderstatus") == "F",
                "PASS",
            ).when(C("o_orderstatus") == "O", "FAIL").otherwise("SKIP").alias("status"),
        )
    )
)
query("option_maps", "select n_nationkey, n_name as title, '' as flag from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        fixtures.options(F.concat(F.lit("title = "), "n_name", F.lit("\nflag, x=1"))).alias("o"),
    ).select("n_nationkey", F.element_at("o", "title").alias("title"), F.element_at("o", "flag").alias("flag"))
)
query("normalized_html", "select n_nationkey, '<p>' || n_name || '</p><p>x</p>' as out from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        fixtures.normalized(
            F.concat(
                F.lit("<body><p data-parsoid='{}'>"),
                "n_name",
                F.lit("<i></i>\n</p>\n<!-- c --><p>x</p>\n</body>"),
            )
        ).alias("out"),
    )
)
query(
    "difference_hint",
    "select n_nationkey, 'at ' || (length(n_name) + 1) || ': ' || substring(n_name || '1', greatest(length(n_name) "
    "+ 1 - 10, 1), 20) || ' / ' || substring(n_name || '2', greatest(length(n_name) + 1 - 10, 1), 20) as hint from "
    "nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        text.difference_hint(F.concat("n_name", F.lit("1")), F.concat("n_name", F.lit("2"))).alias("hint"),
    )
)
query(
    "link_graph_top",
    "select href, count(*) as n from (select unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href "
    "from pages) group by href order by n desc, href limit 20",
)(
    lambda s, d: html.html_links(read(s, d, "pages")).groupBy("href").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("n"), "href").limit(20)
)
query(
    "event_windows",
    "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events "
    "group by all",
)(
    lambda s, d: read(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total"),
    ).select(C("w.start").alias("start"), "event_type", "n", "total")
)
