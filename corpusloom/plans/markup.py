"""More queries: tag classes, kinds, payloads, site facts, node texts, streams of rows at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import site, templates, text, titles
from ..operators import blocks, expand, html
from ..sources import lookups
from .corpus import ALL_TAGS_SQL
from .strings import query, read

C = F.col

query(
    "tag_classes",
    "select tag, count(*) as n, bool_and(tag in ('nav', 'ul', 'li', 'div', 'article', 'h1', 'footer')) as breaks, "
    "bool_and(tag in ('ul', 'li', 'div', 'h1', 'p', 'body')) as blocks from (select unnest(regexp_extract_all(html, "
    "'<(nav|ul|li|div|article|h1|footer|body|b|a)[ >]', 1)) as tag from pages) group by tag",
)(
    lambda s, d: html.html_tags(read(s, d, "pages")).where(
        "not closing and tag in ('nav', 'ul', 'li', 'div', 'article', 'h1', 'footer', 'body', 'b', 'a')"
    ).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(C("tag").isin(*site.PARAGRAPH_BREAKING_TAGS)).alias("breaks"),
        F.bool_and(C("tag").isin(*site.BLOCK_TAGS)).alias("blocks"),
    )
)
query(
    "tag_classes_whole",
    f"select tag, count(*) as n, bool_and(tag in {tuple(site.PARAGRAPH_BREAKING_TAGS)}) as breaks, bool_and(tag in "
    f"{tuple(site.BLOCK_TAGS)}) as blocks from (select unnest({ALL_TAGS_SQL.format('html')}) as tag from pages) "
    f"group by tag",
)(
    lambda s, d: html.html_tags(read(s, d, "pages")).where("not closing").groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(C("tag").isin(*site.PARAGRAPH_BREAKING_TAGS)).alias("breaks"),
        F.bool_and(C("tag").isin(*site.BLOCK_TAGS)).alias("blocks"),
    )
)
query("extension_known", "select n_nationkey, n_nationkey % 2 = 0 as known from nation")(
    lambda s, d: read(s, d, "nation").withColumn(
        "name",
        F.when(C("n_nationkey") % 2 == 0, "math").otherwise("maths"),
    ).join(
        site.dim_extension_tag(s).withColumn("known", F.lit(True)),
        "name",
        "left",
    ).select("n_nationkey", F.coalesce("known", F.lit(False)).alias("known"))
)
query(
    "element_kinds",
    "select n_nationkey, kind from nation cross join (values ('Transclusion'), ('ExtensionTag'), ('Annotation'), "
    "('CategoryLink'), ('ExtLink'), ('Wikilink'), ('Span'), ('Other'), ('Figure')) v(kind)",
)(
    lambda s, d: html.html_tags(
        read(s, d, "nation").select(
            "n_nationkey",
            F.concat(
                F.lit('<span typeof="a mw:Transclusion" rel="mw:PageProp/Category">'),
                "n_name",
                F.lit(
                    '</span><sup typeof="mw:Extension/ref"><meta typeof="mw:Annotation/ref"><link '
                    'rel="mw:PageProp/Category" href="x"><a rel="mw:ExtLink" href="y">z</a><a href=q>z</a><a '
                    'name=q>z</a><nav><figure-inline>'
                ),
            ).alias("html"),
        ),
        "n_nationkey",
    ).where("not closing").select("n_nationkey", C("elem_kind").alias("kind"))
)
query(
    "kind_tags",
    "select column0 as kind, column1 as tag from (values ('Heading', 'h2'), ('Wikilink', 'a'), ('Image', "
    "'figure-inline'), ('CategoryLink', 'link'), ('Other', 'nav'), ('TableCell', 'td')) v(column0, column1)",
)(
    lambda s, d: s.createDataFrame(
        [("Heading", 9), ("Wikilink", 0), ("Image", 0), ("CategoryLink", 0), ("Other", 0), ("TableCell", 0)],
        "kind string, level int",
    ).select("kind", html.kind_tag(C("kind"), C("level"), F.lit("nav")).alias("tag"))
)
query(
    "file_payload",
    "select n_nationkey, n_name as title, 'image/png' as mime_type, n_nationkey::bigint * 10 as size, 640 as width, "
    "'http://x/' || n_name as file_url from nation",
)(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        lookups.file_from_payload(
            F.concat(
                F.lit('{"query":{"pages":[{"title":"'),
                "n_name",
                F.lit('","imageinfo":[{"url":"http://x/'),
                "n_name",
                F.lit('","mime":"image/png","width":640,"height":480,"size":'),
                C("n_nationkey") * 10,
                F.lit("}]}]}}"),
            )
        ).alias("f"),
    ).select("n_nationkey", "f.title", "f.mime_type", "f.size", "f.width", "f.file_url")
)
query(
    "site_facts",
    "select column0 as name, column1 as value from (values ('article_path', '/wiki/$1'), ('language', 'en'), "
    "('script_path', '/w'), ('server', 'https://en.wikipedia.org'), ('site_name', 'Wikipedia')) v(column0, column1)",
)(lambda s, d: s.createDataFrame(sorted(site.SITE.items()), "name string, value string"))
query(
    "namespace_prefixes",
    "select n_nationkey, case n_nationkey when 1 then 'Talk' when 2 then 'User' when 3 then 'User talk' when 4 then "
    "'Project' when 5 then 'Project talk' when 6 then 'File' when 7 then 'File talk' when 8 then 'MediaWiki' when 9 "
    "then 'MediaWiki talk' when 10 then 'Template' when 11 then 'Template talk' when 12 then 'Help' when 13 then "
    "'Help talk' when 14 then 'Category' when 15 then 'Category talk' else '' end as prefix from nation",
)(lambda s, d: read(s, d, "nation").select("n_nationkey", titles.namespace_prefix(C("n_nationkey")).alias("prefix")))
query("is_variable", "select n_nationkey, n_nationkey % 2 = 0 as known from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        templates.is_variable(F.when(C("n_nationkey") % 2 == 0, "CurrentDay2").otherwise(C("n_name"))).alias("known"),
    )
)
query("top_level_args", "select n_nationkey, n_name || ' {x}' as out from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        F.concat_ws(
            " ",
            templates.top_level_arg(F.concat(F.lit("x|"), "n_name")),
            templates.top_level_arg(F.lit("x")),
        ).alias("out"),
    )
)
query(
    "wrapped_transclusions",
    "select n_nationkey as doc_id, '<span typeof=\"mw:Transclusion\">' || n_name || '</span> {{none}}' as expanded "
    "from nation",
)(
    lambda s, d: expand.expand_templates(
        read(s, d, "nation").select(
            C("n_nationkey").alias("doc_id"),
            F.concat(F.lit("{{t|"), "n_name", F.lit("}} {{none}}")).alias("text"),
        ),
        s.createDataFrame([("t", "{{{1}}}")], "title string, content string"),
        wrap=True,
    )
)
query("strip_transclusions", "select n_nationkey, 'a ' || n_name || ' b' as out from nation")(
    lambda s, d: read(s, d, "nation").select(
        "n_nationkey",
        text.strip_transclusion_spans(
            F.concat(F.lit('a <span about="#1" typeof="mw:Transclusion">'), "n_name", F.lit("</span> b"))
        ).alias("out"),
    )
)
query(
    "heading_texts",
    "select page_id, regexp_extract(replace(replace(replace(replace(html, '&quot;', '\"'), '&lt;', '<'), '&gt;', "
    "'>'), '&amp;', '&'), '<h1>(.*?)</h1>', 1) as title from pages",
)(
    lambda s, d: html.with_nodes(
        read(s, d, "pages").select("page_id", "html"),
        C("html"),
        "nodes",
        lambda piece: text.replaced(piece, ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")),
    ).select(
        "page_id",
        F.get(F.filter("nodes", lambda n: n["tag"] == "h1"), 0).alias("top"),
        F.filter("nodes", lambda n: n["node_kind"] == "Text").alias("texts"),
        C("html").isNull().alias("none"),
    ).select(
        "page_id",
        F.when(
            ~C("none"),
            F.coalesce(
                F.array_join(
                    F.transform(
                        F.filter("texts", lambda n: n["path"].startswith(F.concat("top.path", F.lit("/")))), lambda n: n["text"]
                    ),
                    "",
                ),
                F.lit(""),
            ),
        ).alias("title"),
    )
)
query(
    "outline_stats",
    "select p_size as size, count(*) as headings, sum(length(p_brand))::bigint as chars from part group by p_size",
)(
    lambda s, d: blocks.headings(
        read(s, d, "part").select(
            F.struct("p_partkey", "p_size").alias("doc_id"),
            F.concat(F.lit("== "), "p_brand", F.lit(" ==\ntext")).alias("text"),
        )
    ).groupBy(C("doc_id.p_size").alias("size")).agg(
        F.count(F.lit(1)).alias("headings"),
        F.sum(F.char_length("title")).alias("chars"),
    )
)
query("module_titles", "select n_nationkey, 'Module:' || n_name as out from nation")(
    lambda s, d: read(s, d, "nation").select("n_nationkey", lookups.module_title(C("n_name")).alias("out"))
)
