"""python -m corpusloom render|roundtrip|html2wt|nodes|test ... : the operators over files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.blocks import wt2html
from .operators.html import html2wt, html_nodes, html_to_markup, node_json
from .sources import fixtures


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("command", choices=("render", "roundtrip", "html2wt", "nodes", "test"))
    parser.add_argument("path", help="text files with one page each, or fixture files")
    parser.add_argument("--out", help="Parquet folder; without it rows are shown")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if args.command == "test":
        out = fixtures.summary(fixtures.run_cases(fixtures.cases(fixtures.read_lines(spark, args.path))))
    else:
        pages = spark.read.text(args.path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
        if args.command == "html2wt":
            out = html_to_markup(pages, "doc_id", "text")
        elif args.command == "nodes":
            nodes = html_nodes(pages, "doc_id", "text")
            out = nodes.select("doc_id", "node_id", node_json(*(c for c in nodes.columns if c not in ("doc_id", "loom_row", "above", "until"))).alias("json"))
        else:
            out = wt2html(pages)
        if args.command == "roundtrip":
            out = out.select("doc_id", html2wt(F.col("html")).alias("wikitext"))
    if args.out:
        out.write.parquet(args.out)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
