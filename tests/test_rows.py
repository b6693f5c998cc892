"""Awkward rows of the markup operators: nulls, repeats, long and hostile texts, empty tables, extra columns."""

import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import braces, templates, text
from corpusloom.operators import blocks, diff, expand, html, tokens
from corpusloom.sources import lookups

L = F.lit
TEXTS = [(1, "''a''"), (1, "b [[c]]"), (None, "{{T|x}}"), (None, None), (2, ""), (2, ""), (3, "5 {{T|6}}")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1, "z", "r") for i, t in rows], "doc_id long, text string, kind string, line int, place string, html string")


def templates_of(spark):
    return spark.createDataFrame([("T", "<{{{1}}}>"), (None, "none")], "title string, content string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_each_row_has_a_result(spark):
    assert sorted((r["doc_id"] or 0, r["html"]) for r in blocks.wt2html(docs(spark)).collect()) == sorted(
        [(1, "<p><i>a</i></p>"), (1, '<p>b <a rel="mw:WikiLink" href="./c" title="c">c</a></p>'), (0, "<p>{{T|x}}</p>"), (0, ""), (2, ""), (2, ""), (3, "<p>5 {{T|6}}</p>")]
    )
    got = [(r["doc_id"] or 0, r["expanded"]) for r in expand.expand_templates(docs(spark), templates_of(spark)).collect()]
    assert sorted(got) == sorted([(1, "''a''"), (1, "b [[c]]"), (0, "<x>"), (0, ""), (2, ""), (2, ""), (3, "5 <6>")])
    rows = tokens.tokens(docs(spark))
    assert rows.where("kind = 'EOF'").count() == len(TEXTS) and rows.select("loom_row").distinct().count() == len(TEXTS)
    assert sorted(r["x"] for r in rows.groupBy("loom_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "lex"))), lambda t: t["lex"]), "").alias("x")).collect()) == sorted(t or "" for _, t in TEXTS)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert blocks.wt2html(none).count() == tokens.tokens(none).count() == expand.expand_templates(none, templates_of(spark)).count() == 0
    assert html.html_nodes(none, "doc_id").count() == html.html_to_markup(none, "doc_id").count() == blocks.headings(none).count() == 0
    two = none.withColumn("other", F.col("html"))
    assert diff.diff_pages(two, "doc_id", "html", "other").count() == diff.selser(two, "doc_id", "text", "html", "other").count() == 0
    assert expand.expand_templates(docs(spark, [(1, "{{T|x}}")]), templates_of(spark).limit(0)).first()["expanded"] == ""


def test_pages_that_share_a_key(spark):
    rows = [(1, "a", "<p>a</p>", "<p>b</p>"), (1, "c", "<p>c</p>", "<p>c</p>"), (None, "d", "<p>d</p>", "<p>e</p>"), (None, None, None, "<p>f</p>"), (2, "g", "<p>g</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, wikitext string, html0 string, html1 string")
    got = [(r["page_id"], r["wikitext"], r["ignored"]) for r in diff.selser(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "b", 0), (1, "c", 0), (None, "e", 0), (None, "f", 0), (2, "g", 1)], key=repr)
    assert sorted(r["change"] for r in diff.diff_pages(pages).collect()) == ["Deleted", "Inserted", "TextModified", "TextModified"]
    nodes = html.html_nodes(pages, "page_id", "html0")
    assert nodes.where("node_kind = 'Text'").count() == 4 and html.nodes_to_markup(nodes).count() == 4


@pytest.mark.parametrize("depth", [1, 2, 5, 9, 60])
def test_any_depth(spark, depth):
    call = "{{a|" * depth + "x" + "}}" * depth
    assert [(r["kind"], r["lex"]) for r in tokens.tokens(docs(spark, [(1, call)])).orderBy("tok_idx").collect()] == [("TemplateOpen", call), ("EOF", "")]
    argument = "{{{a|" * depth + "x" + "}}}" * depth
    assert [r["kind"] for r in tokens.tokens(docs(spark, [(1, argument)])).orderBy("tok_idx").collect()] == ["TplArgOpen", "EOF"]
    assert value(spark, templates.substitute_args(L(argument), F.create_map(L("b"), L("y")))) == "x"
    assert value(spark, templates.substitute_args(L(argument), F.create_map(L("a"), L("y")))) == "y"


def test_braces(spark):
    held = lambda t: value(spark, braces.released(braces.calls_held(L(t))))
    for t in ("{{a|x^{2}}}", "{ {{a}} }", "{{{{a}}}}", "{{a", "a}}", "<nowiki>{{</nowiki>}}", "{{{{{1}}}}}", "", "1{{a}}"):
        assert held(t) == t
    kinds = lambda t: [(r["kind"], r["lex"]) for r in tokens.tokens(docs(spark, [(1, t)])).where("kind <> 'EOF'").orderBy("tok_idx").collect()]
    assert kinds("{{a|x^{2}}}") == [("TemplateOpen", "{{a|x^{2}}}")]
    assert kinds("{{a {{b}}") == [("Text", "{{a "), ("TemplateOpen", "{{b}}")]
    assert kinds("<!-- {{ -->{{b}}")[1] == ("TemplateOpen", "{{b}}")
    assert [k for k, _ in kinds("{{{a|{{{b}}}}}}")] == ["TplArgOpen"]


def test_values_are_not_read_again(spark):
    tpl = spark.createDataFrame([("T", "{{{x|{{U|{{{y}}}}}}}}"), ("U", "({{{1}}})"), ("p", "{{{1}}}"), ("V", "{{{image|{{{img|{{{logo|none}}}}}}}}}")], "title string, content string")
    texts = ["{{T|y=1}}", "{{T|x=2|y=1}}", "{{p|a{{!}}b}}", "{{V|image=i}}", "{{V|logo=l}}", "{{V}}", "{{{q|{{p|z}}}}}", "{{#nope:1}} {{p|{b}}}", "{{{a|{b}}}}"]
    got = {r["doc_id"]: r["expanded"] for r in expand.expand_templates(docs(spark, list(enumerate(texts))), tpl).collect()}
    assert [got[i] for i in range(len(texts))] == ["(1)", "2", "a|b", "i", "l", "none", "z", "{{#nope|...}} {b}", "{b}"]


def test_long_texts_take_seconds(spark):
    began = time.time()
    many = docs(spark, [(1, "[[a|b]] {{c|d}}\n" * 20000), (2, "x" * 2_000_000), (3, "{{" * 20000), (4, "=a!" * 200000)])
    assert tokens.tokens(many).where("kind = 'WikilinkOpen'").count() == 20000
    pages = spark.createDataFrame([(1, "<ul>" + "<li><a href='/x'>y</a>" * 20000 + "</ul>"), (2, "<div>" * 5000), (3, "<a " * 16000)], "page_id long, html string")
    assert html.html_links(pages).count() == 20000 and html.html_to_markup(pages).count() == 3
    assert time.time() - began < 90


def test_small_functions(spark):
    assert value(spark, text.normalize_paragraphs(L("<b><i><b></b></i></b>x\n\n</p>\n<p>"))) == "x</p><p>"
    assert value(spark, text.difference_hint(L("abcdef"), L("abcXef"), 2)) == "at 4: bcde / bcXe"
    assert value(spark, text.difference_hint(L("ab"), L("abc"))) == "at 3: ab / abc" and value(spark, text.difference_hint(L("a"), L("a"))) is None
    c = lookups.in_memory(spark, modules=[("Module:A", "m")], pages=[("Template:B", "t"), ("MediaWiki:k", "v")])
    assert [r["content"] for r in lookups.modules(spark.createDataFrame([("A",), ("Module:A",), ("B",)], "name string"), c).orderBy("name").collect()] == ["m", None, "m"]
    assert lookups.prefixed_lookup(spark.createDataFrame([("template: B",)], "name string"), c.pages, "Template", 10).first()["content"] == "t"


def test_nested_markup(spark):
    page = "<ul><li>a<ol><li>b<li>c</ol><li>d</ul><dl><dt>x<dd>y</dl><table><tr><td>1<td>2<tr><th>3</table>"
    assert value(spark, html.html2wt(L(page))) == "* a\n## b\n## c\n* d\nxy{|\n|-\n|1\n|2\n|-\n!3\n|}\n"
    assert value(spark, html.html2wt(L('<a href="u">u</a> <a href="u"></a> <a rel="mw:ExtLink" href="h">t <b>b</b></a>'))) == "[[u]] [[u]] [h t '''b''']"
    assert value(spark, html.html2wt(L(None).cast("string"))) == ""


def test_commands(spark, tmp_path):
    from corpusloom.__main__ import main

    (tmp_path / "a.html").write_text("<h2>T</h2><p>x &eacute;</p>")
    for command in ("html2wt", "nodes"):
        main([command, str(tmp_path / "a.html"), "--out", str(tmp_path / command)])
    assert spark.read.parquet(str(tmp_path / "html2wt")).first()["wikitext"] == "==T==\nx é\n"
    shown = [r["json"] for r in spark.read.parquet(str(tmp_path / "nodes")).orderBy("node_id").collect()]
    assert len(shown) == 4 and '"text":"x é"' in shown[3] and '"elem_kind":"Heading"' in shown[0]


def test_one_file_is_worked_on_by_many_tasks(spark, tmp_path, capsys):
    """What is costly for each row comes after the rows are dealt out, and token rows are not shuffled again."""
    from corpusloom.plans import corpus, trees  # noqa: F401  they register their queries
    from corpusloom.plans.strings import QUERIES

    folder = str(tmp_path / "part.parquet")
    spark.range(64).selectExpr("id as p_partkey", "'a b' as p_name", "'c' as p_brand", "'d' as p_type", "1 as p_size").coalesce(1).write.parquet(folder)
    docs = spark.read.parquet(folder).selectExpr("p_partkey as doc_id", "concat('<b>', p_name, '</b>') as text")
    assert docs.rdd.getNumPartitions() == 1
    several = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = [tokens.tokens(docs), html.html_nodes(docs, "doc_id", "text"), html.html_to_markup(docs, "doc_id", "text"), expand.expand_templates(docs, spark.createDataFrame([], "title string, content string"))]
    made += [QUERIES[name](spark, str(tmp_path)) for name in ("html2wt", "html2wt_tables", "html2wt_other", "html2wt_rebuilt", "html2wt_nested_lists")]
    for rows in made:
        assert rows.rdd.getNumPartitions() == several
    capsys.readouterr()
    tokens.tokens(docs).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")


def test_places_in_few_objects():
    """Batches are cut by their pieces; null pages, empty pages and one page of many pieces come back whole."""
    import pyarrow as pa

    pages = [None, [], ["+p -", ".", "-p"], ["."] * (html.PIECES + 5), *[["."] * 4000] * 11]
    parts = list(html._arrays(pa.array(pages, pa.list_(pa.string()))))
    assert [len(x) for p in parts for x in p.to_pylist()] == [len(p or []) for p in pages]
    assert all(len(p) == 1 or len(p.flatten()) <= html.PIECES for p in parts) and len(parts) == 5
    first = parts[0].to_pylist()[2]
    assert first[0]["until"] == 2 and first[1]["path"] == "/00000/00000" and first[2] is None
