"""Pinned inputs and outputs of the markup operators."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import templates, text, titles
from corpusloom.functions.registry import ExtensionTags, Modules
from corpusloom.operators import blocks, diff, expand, html, tokens
from corpusloom.sources import fixtures, lookups
from corpusloom.sources.wiki_api import WikiApiSource

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    "title, want",
    [
        ("Template:Foo", (None, 10, "Foo", None)), ("Image:Example.jpg", (None, 6, "Example.jpg", None)), (":Category:People", (None, 0, "Category:People", None)),
        ("Foo#Section", (None, 0, "Foo", "Section")), ("commons:File:Example.jpg", ("commons", 0, "File:Example.jpg", None)), ("", (None, 0, "", None)), ("A: b", (None, 0, "A: b", None)),
    ],
)
def test_titles(spark, title, want):
    assert tuple(value(spark, titles.parse_title(L(title)))) == want


def test_title_display(spark):
    assert value(spark, titles.display_title(titles.parse_title(L("Template:Foo#x")))) == "Template:Foo#x"


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: text.html_escape(L("<>&\"'")), "&lt;>&amp;\"'"), (lambda: text.attr_escape(L("<>&\"'")), "&lt;>&amp;&quot;&#39;"), (lambda: text.uri_encode(L("hello world")), "hello+world"),
        (lambda: text.anchor_encode(L("Hello World?")), "Hello_World%3F"), (lambda: text.format_num(L(1234567.0)), "1,234,567"), (lambda: text.format_num(L(-123456.0)), "-123,456"),
        (lambda: text.ustring_sub(L("hello world"), L(7), L(5)), "world"), (lambda: text.uri_decode(L("a+%zz")), "a %zz"), (lambda: text.trim_all(L("  x　")), "x"),
        (lambda: templates.magic_pipe(L("a{{!}}b")), "a|b"), (lambda: templates.without_noinclude(L("before<noinclude>hidden</noinclude>after")), "beforeafter"),
        (lambda: templates.without_includeonly_tags(L("<includeonly>keep</includeonly>drop")), "keepdrop"), (lambda: templates.only_onlyinclude(L("drop<onlyinclude>keep</onlyinclude>drop")), "keep"),
        (lambda: templates.substitute_args(L("Hello {{{1}}}!"), F.create_map(L("1"), L("world"))), "Hello world!"), (lambda: templates.substitute_args(L("{{{missing|default}}}"), F.create_map(L("1"), L("x"))), "default"),
        (lambda: templates.substitute_args(L("{{{outer|{{{1}}}}}}"), F.create_map(L("1"), L("inner"))), "inner"), (lambda: templates.arg_reference(L("1|"))["dflt"], ""), (lambda: templates.arg_reference(L("1"))["dflt"], None),
        (lambda: templates.pf_expr(L("2 + 3 * 4")), "14"), (lambda: templates.pf_expr(L("(2 + 3) * 4")), "20"), (lambda: templates.pf_expr(L("")), ""), (lambda: templates.pf_expr(L("1 / 3")), "0.333333"), (lambda: templates.pf_expr(L("-7 % 3")), "-1"),
        (lambda: templates.pf_expr(L("2 * (3 + ")), "6"), (lambda: templates.pf_titleparts(L("a/b/c/d"), L(2), L(2)), "b/c"), (lambda: templates.pf_switch(L("b"), F.array(L("a=Alpha"), L("b=Beta"), L("Default"))), "Beta"),
        (lambda: templates.pf_switch(L("missing"), F.array(L("a=Alpha"), L("Default"))), "Default"), (lambda: templates.pf_tag(L("ref"), L("Citation"), F.create_map(L("name"), L("foo"))), '<ref name="foo">Citation</ref>'),
        (lambda: html.html2wt(L("<p>Hello <b>world</b></p>")), "Hello '''world'''\n"), (lambda: html.html2wt(L("<h2>Title</h2>")), "==Title==\n"),
    ],
)
def test_values(spark, make, want):
    assert value(spark, make()) == want


def test_named_arguments_come_first(spark):
    call = templates.parse_invocation(L("Card|pos1|1=named1|suit=Spades"))
    got = spark.range(1).select(call.alias("c")).select(templates.get_arg(F.col("c"), L("1")), templates.template_args(F.col("c"))).first()
    assert got[0] == "named1" and got[1] == {"1": "named1", "suit": "Spades"}


def kinds(spark, markup):
    rows = tokens.tokens(docs(spark, markup)).orderBy("tok_idx").collect()
    return [(r["kind"], r["s"]) for r in rows]


def test_tokens(spark):
    assert kinds(spark, "") == [("EOF", None)]
    assert kinds(spark, "** item")[0] == ("ListItem", "**")
    assert [k for k, _ in kinds(spark, "[[Main Page]]")] == ["WikilinkOpen", "Text", "WikilinkClose", "EOF"]
    assert kinds(spark, "{{A|{{B}}}}") == [("TemplateOpen", "A"), ("EOF", None)]
    assert [s for k, s in kinds(spark, "<!-- --><!----><!--&#x2D;--><!--&#x2D;&#x2D;-->") if k == "Comment"] == [" ", "", "&#x2D;", "&#x2D;&#x2D;"]
    assert kinds(spark, "<nowiki>'''not bold'''</nowiki>")[0] == ("NowikiContent", "'''not bold'''")
    assert kinds(spark, "#REDIRECT [[Target Page]]")[0] == ("Redirect", "Target Page")
    assert kinds(spark, "a * b == c") == [("Text", "a * b == c"), ("EOF", None)]
    assert kinds(spark, "{{#if:x|y}}{{{n|d}}}")[:2] == [("ParserFnOpen", "#if"), ("TplArgOpen", "n")]


@pytest.mark.parametrize(
    "line, want",
    [
        ("'''''a'''''", "<i><b>a</b></i>"), ("'''''a'' b'''", "<b><i>a</i> b</b>"), ("'''''a''' b''", "<i><b>a</b> b</i>"), ("''a '''b'' c'''", "<i>a <b>b</b></i><b> c</b>"),
        ("''''a'''", "'<b>a</b>"), ("'''''''a'''''", "''<i><b>a</b></i>"), ("''a", "<i>a</i>"), ("no quotes", "no quotes"), ("it's", "it's"), ("x '''a'' b", "x '<i>a</i> b"),
    ],
)
def test_quotes(spark, line, want):
    assert value(spark, tokens.inline_quotes(L(line))) == want


def test_wt2html(spark):
    pages = ["para one\n\npara two", "", None, "* a\n* b\n# c", "----", "<div>\ntext\n</div>", "<pre>\n* a\n</pre>", "[http://a.b c] & <x", "; t\n: d", "a <!-- x-y --> b", "<nowiki>a & '''b''' [[c]] <i></nowiki> ''d''"]
    got = {r["doc_id"]: r["html"] for r in blocks.wt2html(docs(spark, *pages)).collect()}
    assert got[0] == "<p>para one</p>\n<p>para two</p>" and got[1] == "" and got[2] == ""
    assert got[3] == "<ul><li>a</li>\n<li>b</li></ul>\n<ol><li>c</li></ol>" and got[4] == "<hr/>"
    assert got[5] == "<div>\n<p>text</p>\n</div>" and got[6] == "<pre>\n* a\n</pre>"
    assert got[7] == '<p><a rel="mw:ExtLink" href="http://a.b">c</a> &amp; &lt;x</p>'
    assert got[8] == "<dl><dt>t</dt>\n<dd>d</dd></dl>" and got[9] == "<p>a <!-- x&#x2D;y --> b</p>"
    assert got[10] == "<p>a &amp; '''b''' [[c]] &lt;i> <i>d</i></p>"


def test_expansion(spark):
    tpl = spark.createDataFrame([("1x", "{{{1}}}"), ("loop", "{{loop}}"), ("nest", "<{{1x|{{{1}}}}}>"), ("inc", "a<noinclude>b</noinclude>")], "title string, content string")
    texts = ["{{1x|hello}}", "{{nest|{{1x|z}}}}", "{{gone}}!", "{{#ifeq: a | a | {{inc}} | no}}", "{{CURRENTYEAR}} {{{p|q}}} {{{r}}}", "plain {{", "{{#ifexist: Here | yes | no}}{{#ifexist: There | yes | no}}"]
    got = {r["doc_id"]: r["expanded"] for r in expand.expand_templates(docs(spark, *texts), tpl, pages=spark.createDataFrame([("Here",)], "title string"), max_depth=6, now=F.to_timestamp(L("2026-07-31"))).collect()}
    assert [got[i] for i in range(7)] == ["hello", "<z>", "!", "a", "2026 q {r}", "plain {{", "yesno"]
    loop = expand.expand_templates(docs(spark, "x {{loop}}"), tpl, max_depth=3).collect()
    assert [r["expanded"] for r in loop] == ["x {{loop}}"]


def test_nodes_and_diff(spark):
    page = lambda x: spark.createDataFrame([(1, f"<body>{x}</body>")], "page_id long, html string")
    nodes = {r["path"]: (r["node_kind"], r["elem_kind"], r["text"]) for r in html.html_nodes(page("<p>a <b>b</b><br>c<p class=x>d &amp; e<!-- n -->")).collect()}
    assert nodes["/00000"] == ("Element", "Paragraph", None) and nodes["/00000/00001/00000"] == ("Text", None, "b")
    assert nodes["/00001/00000"] == ("Text", None, "d & e") and nodes["/00001/00001"] == ("Comment", None, " n ")
    change = lambda a, b: sorted((r["change"], r["path"]) for r in diff.diff_nodes(html.html_nodes(page(a)), html.html_nodes(page(b))).collect())
    assert change("<p>a</p><!--c-->", "<p>a</p><!--c-->") == []
    assert change("<p>a</p>", "<p>a</p><div><b>x</b></div>") == [("Inserted", "/00001")]
    assert change("<p>a</p><p>b</p>", "<p>a</p>") == [("Deleted", "/00001")]
    assert change("<p id=1>a</p><i>x</i>", "<p id=2>b</p><b>x</b>") == [("AttrsModified", "/00000"), ("ChildrenModified", "/00001"), ("TextModified", "/00000/00000")]


def test_selser(spark):
    rows = [(1, "Hello world", "<p>Hello world</p>", "<p>Hello world</p>"), (2, "Hello world", "<p>Hello world</p>", "<p>Hello there</p>"), (3, "a", "<p>a</p>", "<p>a</p><p>b</p>")]
    got = {r["page_id"]: r["wikitext"] for r in diff.selser(spark.createDataFrame(rows, "page_id long, wikitext string, html0 string, html1 string")).collect()}
    assert got[1] == "Hello world" and got[2] == "Hello there" and got[3].startswith("a")


def test_lookups(spark):
    c = lookups.in_memory(spark, pages=[("A", "page")], templates=[("A", "no"), ("T", "tpl")], redirects=[("R", "A")], messages=[("en", "k", "v")])
    want = spark.createDataFrame([("A",), ("T",), ("R",), ("Q",)], "title string")
    assert {r["title"]: r["content"] for r in lookups.page_content(want, c).collect()} == {"A": "page", "T": "tpl", "R": None, "Q": None}
    assert {r["title"]: r["target"] for r in lookups.resolved(want, c).collect()}["R"] == "A"
    stamped = spark.createDataFrame([("A", "2024-01-01 00:00:00")], "title string, fetched_at string")
    assert lookups.fresh(stamped, L("2024-01-01 00:00:00").cast("timestamp"), 0).count() == 0
    assert lookups.fresh(stamped, L("2024-01-01 00:01:00").cast("timestamp"), 300).count() == 1


def test_api_source(spark):
    spark.dataSource.register(WikiApiSource)
    rows = spark.read.format("wiki_api").option("titles", '["A", "B"]').option("payloads", '{"A": {"query": {"pages": [{"title": "A", "revisions": [{"content": "text"}]}]}}}').load()
    got = {r["title"]: r for r in rows.withColumn("content", lookups.page_from_payload(F.col("payload"))).collect()}
    assert got["A"]["content"] == "text" and got["B"]["content"] is None and "LookupError" in got["B"]["error"]


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><revision><text>x</text></revision></page><page><title>T</title><ns>10</ns><revision><text>y</text></revision></page></mediawiki>")
    assert sorted((r["title"], r["ns"], r["content"]) for r in lookups.read_dump(spark, str(tmp_path / "d.xml")).collect()) == [("A", 0, "x"), ("T", 10, "y")]


def test_golden_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("!! Version 2\n# note\n!! article\nTemplate:x\n!! text\n# kept\n!! endarticle\n\n!! test\nBold\n!! options\nparsoid=a, b\n!! wikitext\n'''x'''\n# item\n!! html/parsoid\n<p><b>x</b></p>\n<ol><li>item</li></ol>\n!! end\n!!test\nNo\n!! wikitext\na\n!! html\n<p>b</p>\n!!end\n!! test\nSkip\n!! wikitext\na\n!! html\nNOT NEEDED\n!! end\n")
    cases = fixtures.cases(fixtures.read_lines(spark, str(tmp_path / "t.txt")))
    assert {(r["kind"], r["title"]) for r in cases.collect()} == {("article", "Template:x"), ("test", "Bold"), ("test", "No"), ("test", "Skip")}
    assert cases.where("kind = 'article'").first()["text"] == "# kept"
    results = fixtures.run_cases(cases)
    assert {r["title"]: r["status"] for r in results.collect()} == {"Bold": "PASS", "No": "FAIL", "Skip": "SKIP"}
    total = fixtures.summary(results).where("path is null").first()
    assert (total["total"], total["passed"], total["failed"], total["skipped"]) == (3, 1, 1, 1)


def test_registries(spark):
    modules, tags = Modules(), ExtensionTags()
    modules.register("join", lambda args: "-".join(args))
    modules.register("table", lambda args: {})
    tags.register("Ref", lambda body, attrs: F.upper(body))
    row = spark.range(1).select(modules.call("join", F.array(L("a"), L("b"))).alias("a"), modules.call("table", F.array(L("a"))).alias("b"), tags.apply(L("x<ref>y</ref>")).alias("c")).first()
    assert tuple(row) == ("a-b", "", "xY") and "join" in modules and "REF" in tags


def test_streams(spark, sf, tmp_path):
    from corpusloom.streaming import edits

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.write.parquet(str(tmp_path / "in"))
    stream = edits.edited_markup(edits.edits(spark, str(tmp_path / "in"), pages.schema))
    q = stream.writeStream.format("memory").queryName("edited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("edited").count() == pages.count()
    batch = edits.edited_markup(pages)
    assert batch.exceptAll(spark.table("edited")).count() == 0
