"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from corpusloom.plans.strings import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "ord", "href"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, views, name):
    df = QUERIES[name](spark, sf)
    answer = views.execute(SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in answer.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want


def test_whole_queries(spark, tmp_path):
    """Rows with ß, null texts, negative starts on long texts and every tag, by hand."""
    spark.createDataFrame([(1, "Straße"), (2, None), (3, "abcdefghijklmnop")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    page = "<html><head><title>a<b></title><style>p{}</style></head><body><!-- <i> --><h2>x</h2><p>y<a href='/z'>z</a><script>var t='<p>'</script></p></body></html>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = lambda name: sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert rows("ustring_upper_whole") == [(1, "STRASSE"), (2, None), (3, "ABCDEFGHIJKLMNOP")]
    assert rows("ustring_sub_whole") == [(1, "raße|raße|tr"), (2, None), (3, "cdefghi|mnop|bcdefghijklm")]
    assert rows("html_tag_counts_whole") == sorted(((1, t, 1) for t in "html head title style body h2 p a script".split()), key=repr)
    assert {(k, n) for _, k, n in rows("html_elements_whole")} >= {("Heading", 1), ("Paragraph", 1), ("Wikilink", 1)}
    assert sum(n for _, _, n in rows("html_elements_whole")) == 4
    assert {t for t, *_ in rows("tag_classes_whole")} == set("html head title style body h2 p a script".split())


def compared(spark, name, folder, table):
    """The query's rows and those of its SQL over one table in the folder."""
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    return sorted(repr([plain(r[c]) for c in names]) for r in df.collect()), sorted(repr(list(map(plain, r))) for r in answer.fetchall())


def test_list_groups_without_values(spark, tmp_path):
    """Null kinds are like each other; null places come last."""
    kinds = [(1, 1, None), (1, 2, None), (1, 3, "A"), (1, None, "B"), (1, 4, "A"), (2, 1, "A"), (2, 2, None), (2, 3, None), (None, 1, "A"), (None, 2, "A")]
    rows = [(key, at, 1.0, 5, kind) for key, at, kind in kinds] + [(3, 1, None, 5, "A"), (3, 1, 2.0, None, "B"), (3, 1, 2.0, 7, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = compared(spark, "list_groups", tmp_path, "lineitem")
    assert got == want


def test_heading_texts_of_other_pages(spark, tmp_path):
    """References cut off at their ends or unknown to the SQL, pages without a heading, repeated keys."""
    heads = ["<h1>a &amp;&amp;&amp</h1>", "<h1>it&#x27;s &lt;x&gt; &quot;&copy;&quot;</h1>", "<p>none</p>", "<h1></h1>", "<h1>one</h1><h1>two</h1>"]
    rows = [(i, f"<html><body>{h}<p>x</p></body></html>") for i, h in enumerate(heads)] + [(0, "<h1>again</h1>"), (None, "<h1>b</h1>"), (9, None), (10, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = compared(spark, "heading_texts", tmp_path, "pages")
    assert got == want
