"""Tree difference as a full outer join, and selective patching of the original markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import source_range
from ..functions.text import trim_all
from .html import html_nodes, markup_of_nodes, with_nodes
from .rows import ROW, by_row, names_of, numbered


def diff_nodes(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """key, path, change, old_text, new_text: what differs between two node tables, by place in the tree.

    Inserted, Deleted, ChildrenModified (other node or element kind), AttrsModified, TextModified.
    What lies below an inserted, deleted or replaced node is not listed again.

    Rows: the key must name one page on either side, a null key is the page without one; pages whose
    rows share a key are compared by diff_pages, which has both versions in one row. Equal tables
    and empty tables give no rows.
    """
    sides = [d.select(F.col(key).alias(f"{n}_key"), F.col("path").alias(f"{n}_path"), F.struct("node_kind", "elem_kind", "tag", "level", "text", "attrs").alias(n)) for d, n in ((old, "o"), (new, "n"))]
    same = F.col("o_key").eqNullSafe(F.col("n_key")) & (F.col("o_path") == F.col("n_path"))
    both = sides[0].join(sides[1], same, "full_outer")
    o, n = F.col("o"), F.col("n")
    owner = F.when(o.isNotNull(), F.col("o_key")).otherwise(F.col("n_key"))
    both = both.select(owner.alias(key), F.coalesce("o_path", "n_path").alias("path"), "o", "n")
    other_kind = (o["node_kind"] != n["node_kind"]) | ~o["elem_kind"].eqNullSafe(n["elem_kind"]) | ~o["level"].eqNullSafe(n["level"]) | ~o["tag"].eqNullSafe(n["tag"])
    change = (
        F.when(o.isNull(), "Inserted").when(n.isNull(), "Deleted").when(other_kind, "ChildrenModified")
        .when(~o["attrs"].eqNullSafe(n["attrs"]), "AttrsModified").when(~o["text"].eqNullSafe(n["text"]), "TextModified")
    )
    found = both.withColumn("change", change).where("change is not null")
    above = found.where(F.col("change").isin("Inserted", "Deleted", "ChildrenModified")).select(F.col(key).alias("a_key"), F.col("path").alias("a_path"))
    parts = F.split("path", "/")
    uppers = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    ups = found.select(F.col(key).alias("b_key"), F.col("path").alias("b_path"), F.explode(uppers).alias("top")).where("top <> b_path")
    below = ups.join(above, F.col("b_key").eqNullSafe(F.col("a_key")) & (F.col("top") == F.col("a_path")), "left_semi").select("b_key", "b_path").distinct()
    listed = found.join(below, F.col(key).eqNullSafe(F.col("b_key")) & (F.col("path") == F.col("b_path")), "left_anti")
    return listed.select(key, "path", "change", F.col("o.text").alias("old_text"), F.col("n.text").alias("new_text"))


def diff_pages(docs: DataFrame, key: str = "page_id", html0: str = "html0", html1: str = "html1") -> DataFrame:
    """loom_row, key, path, change, old_text, new_text: diff_nodes for two versions of a page in one row.

    Pages whose versions are equal are neither parsed nor shuffled.

    Rows: every input row is a page of its own, whether its key is null or repeated; a null version
    has no nodes; other columns are left out.
    """
    edited = numbered(docs, key, html0, html1).where(~F.col(html0).eqNullSafe(F.col(html1)))
    changes = diff_nodes(html_nodes(edited, ROW, html0), html_nodes(edited, ROW, html1), ROW)
    if key == ROW:
        return changes
    return changes.join(edited.select(ROW, key), ROW).select(ROW, key, "path", "change", "old_text", "new_text")


def source_regions(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, s, e: source byte ranges that nodes carry, merged where they overlap, in order of start."""
    r = nodes.select(key, source_range(F.col("data_parsoid")).alias("r")).where("r is not null").select(key, "r.s", "r.e")
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    r = r.withColumn("island", F.sum("new").over(w))
    return r.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.char_length(old), F.char_length(text)))
    return F.when((at > 0) & (old != ""), cut).otherwise(text)


def selser(docs: DataFrame, key: str = "page_id", wikitext: str = "wikitext", html0: str = "html0", html1: str = "html1") -> DataFrame:
    """key, wikitext, ignored: the original markup with the edits of the HTML applied.

    Changed texts replace the first place of the old text; of inserted nodes the markup is appended;
    pages whose HTML did not change keep their markup verbatim. ignored counts changes of other kinds.

    Rows: every input row gives one row, whether its key is null or repeated; a null markup is empty
    where there are edits; other columns are left out.
    """
    names, rows = names_of(docs, key), numbered(docs, key, wikitext, html0, html1)
    changes = diff_pages(rows, ROW, html0, html1)
    inserted = (F.col("change") == "Inserted")
    per_page = changes.groupBy(ROW).agg(
        F.array_sort(F.collect_list(F.when(F.col("change") == "TextModified", F.struct("path", "old_text", "new_text")))).alias("edits"),
        F.array_sort(F.collect_list(F.when(inserted, F.col("path")))).alias("added"),
        F.count_if(~F.col("change").isin("TextModified", "Inserted")).alias("ignored"),
    )
    edited = rows.join(per_page, ROW)
    grown = with_nodes(edited.withColumn("page", F.when(F.size("added") > 0, F.col(html1))), F.col("page"), "nodes")
    below = lambda path: F.filter("nodes", lambda n: (n["path"] == path) | n["path"].startswith(F.concat(path, F.lit("/"))))
    texts = F.transform("added", lambda path: F.concat(F.lit("\n"), markup_of_nodes(below(path))))
    patched = F.aggregate("edits", F.coalesce(wikitext, F.lit("")), lambda t, e: replace_first(t, e["old_text"], e["new_text"]))
    patched = grown.select(ROW, trim_all(F.concat(patched, F.array_join(texts, ""))).alias("patched"), "ignored")
    out = rows.join(patched, ROW, "left")
    return out.select(*names, F.when(F.col("ignored").isNull(), F.col(wikitext)).otherwise(F.col("patched")).alias("wikitext"), F.coalesce("ignored", F.lit(0)).alias("ignored"))
