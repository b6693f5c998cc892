"""From documents to a training mix: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage as Parquet
in the shared folder and reads it again as the next stage's docs. Tables that a stage made for itself
go when it is written, and so does the table that it read, unless that is the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, joined, remove, scratch, table, written
from corpusloom.llm.op1_quality import THRESHOLD, learn, score
from corpusloom.llm.op2_minhash import decided, digest_of
from corpusloom.llm.op4_sharding import with_shard
from corpusloom.llm.op5_mixing import mixed
from corpusloom.llm.op9_decontaminate import clean_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col(free_name(docs, "quality_score")) >= THRESHOLD).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (5 words, 0.8): the one with the smallest id.

    Rows are decided by id and text. Rows of one id with texts that are no near-duplicates stay both;
    rows without an id go where a row with an id has a near-duplicate text. Rows with blank texts stay,
    once for each id and text, or all of them where they have no id.
    """
    found = written(decided(docs, k=5, percent=80).select("doc_id", "d1", "d2", "chosen"), "near")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("chosen").alias("some"))
    dropped = written(ids.where("not some").select("doc_id"), "dropped")
    often = written(ids.where("some and n > 1").select("doc_id"), "often")
    named = docs.where("doc_id is not null")
    parts = [joined(named, dropped.union(often), ["doc_id"], F.col("text"), "left_anti").select(*docs.columns)]
    mark = free_name(docs, "digest")
    held = [F.coalesce(f"{mark}.d1", F.lit(0)), F.coalesce(f"{mark}.d2", F.lit(0))]
    blank = F.col(f"{mark}.d1").isNull()

    def chosen(rows: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows whose id and digest are among keys, one row of each; of blank texts one of each text."""
        rows = rows.withColumn(mark, digest_of(F.col("text"), 5))
        names = [free_name(rows, f"key_{c}") for c in ("doc_id", "d1", "d2")]
        keys = keys.select(F.col("doc_id").alias(names[0]), F.coalesce("d1", F.lit(0)).alias(names[1]), F.coalesce("d2", F.lit(0)).alias(names[2])).distinct()
        on = F.col("doc_id").eqNullSafe(F.col(names[0])) & (held[0] == F.col(names[1])) & (held[1] == F.col(names[2]))
        rows = rows.join(keys, on, "left_semi")
        one = free_name(rows, "one")
        return rows.withColumn(one, F.when(blank, F.col("text"))).dropDuplicates(["doc_id", mark, one]).select(*docs.columns)

    if not often.isEmpty():
        parts.append(chosen(joined(named, often, ["doc_id"], F.col("text"), "left_semi").select(*docs.columns), joined(found.where("chosen"), often, ["doc_id"], F.col("d1"), "left_semi")))
    if not found.where("doc_id is null").isEmpty():
        nameless = docs.where("doc_id is null")
        parts.append(chosen(nameless, found.where("chosen and doc_id is null and d1 is not null")))
        parts.append(nameless.withColumn(mark, digest_of(F.col("text"), 5)).where(blank).select(*docs.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows, with or without an id, whose text holds passages of the benchmark."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics come near their target weights."""
    return mixed(docs).where(F.col(free_name(docs, "mix_kept"))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of the shard that each document belongs to."""
    return with_shard(docs).drop(free_name(docs, "slot"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the sketches are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            after = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), lasting=True)
        if i:  # a table of the stage before, not the input
            remove(docs)
        docs = after
    return docs
