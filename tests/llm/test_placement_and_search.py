"""Sharding, mixing, exact search and the pipeline against brute force."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, op1_quality, op4_sharding, op5_mixing, op9_decontaminate, op10_topk
from corpusloom.llm.queries import QUERIES

from .helpers import awkward, documents, empty
from .test_sets import plain_components

# ---------------------------------------------------------------- 4 sharding


def plain_table(names, slots):
    """Every shard's whole permutation, claimed turn by turn."""
    order = [[(xxhash.xxh64_intdigest(n.encode(), seed=1) + i * (xxhash.xxh64_intdigest(n.encode(), seed=2) % (slots - 1) + 1)) % slots for i in range(slots)] for n in names]
    owner, turn = {}, 0
    while len(owner) < slots:
        shard = turn % len(names)
        owner[next(s for s in order[shard] if s not in owner)] = shard
        turn += 1
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("shards, slots", [(1, 7), (3, 13), (7, 101), (16, 509)])
def test_lookup_table(shards, slots):
    names = [f"shard-{i:05d}" for i in range(shards)]
    got = op4_sharding.lookup_table(names, slots)
    assert got == plain_table(names, slots)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    before = op4_sharding.lookup_table([f"shard-{i:05d}" for i in range(64)])
    after = op4_sharding.lookup_table([f"shard-{i:05d}" for i in range(65)])
    assert sum(a != b for a, b in zip(before, after)) < 0.08 * len(before)


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            op4_sharding.lookup_table(names, slots)


def test_placement(spark, tmp_path):
    docs = awkward(spark)
    owner = op4_sharding.lookup_table([f"shard-{i:05d}" for i in range(op4_sharding.SHARDS)])
    rows = op4_sharding.with_shard(docs).collect()
    assert len(rows) == docs.count() and op4_sharding.with_shard(empty(spark)).collect() == []
    for r in rows:
        if r["doc_id"] is not None:
            h = xxhash.xxh64_intdigest(int(r["doc_id"]).to_bytes(8, "little", signed=True), seed=42)
            h -= (1 << 64) * (h >> 63)
            assert r["slot"] == h % op4_sharding.SLOTS and r["shard"] == owner[r["slot"]]
    op4_sharding.write_shards(docs, str(tmp_path / "out"), splits=2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect() and spark.read.parquet(str(tmp_path / "out")).count() == 13
    again = op4_sharding.with_shard(docs.withColumn("Shard", F.lit(-1))).collect()
    assert sorted(r["_shard"] for r in again) == sorted(r["shard"] for r in rows) and {r["Shard"] for r in again} == {-1}


# ---------------------------------------------------------------- 5 mixing


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (5 + i % 7) + ("x | y" if i % 3 == 0 else ""), "en" if i // 4 % 2 else "de", f"s{i % 4 if i % 5 else 0}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}, "lang": {"en": 0.3, "de": 0.7}, "topic": 1.0}
    out = [r.asDict() for r in op5_mixing.mixed(docs, targets, keep=0.4).collect()]
    words = {i: len(t.split()) for i, t, _, _ in rows}
    assert all(r["mix_tokens"] == words[r["doc_id"]] for r in out)
    total = sum(r["mix_tokens"] * r["mix_weight"] for r in out)
    for dim, want in (("lang", {"en": 0.3, "de": 0.7}), ("source", {f"s{i}": 0.25 for i in range(4)})):
        for k, share in want.items():
            assert sum(r["mix_tokens"] * r["mix_weight"] for r in out if r[dim] == k) / total == pytest.approx(share, abs=1e-6)
    assert total == pytest.approx(sum(words.values()), rel=1e-6)
    for r in out:
        assert r["mix_probability"] == pytest.approx(min(1, 0.4 * r["mix_weight"]))
    kept = sum(r["mix_kept"] for r in out)
    assert abs(kept - sum(r["mix_probability"] for r in out)) < 5 * math.sqrt(600 * 0.25)


def test_mixing_makes_up_for_full_cells(spark):
    """The cell (s0, en) is at its bound; the targets are still met by the other cells."""
    cells = [("s0", "en", 200), ("s0", "de", 2600), ("s1", "en", 2600), ("s1", "de", 4600)]
    docs = spark.createDataFrame([(i * 1000 + j, "w " * 100, lang, source) for i, (source, lang, n) in enumerate(cells) for j in range(n // 100)], "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.45, "s1": 0.55}, "lang": {"en": 0.45, "de": 0.55}, "topic": 1.0}
    free = op5_mixing.mixed(docs, targets, keep=0.6, bounded=False)
    assert free.agg(F.max("mix_weight")).first()[0] > 1 / 0.6
    out = [r.asDict() for r in op5_mixing.mixed(docs, targets, keep=0.6).collect()]
    total = sum(r["mix_tokens"] * r["mix_probability"] for r in out)
    assert total == pytest.approx(0.6 * 10000, rel=1e-6)
    for dim, name, share in (("source", "s0", 0.45), ("lang", "en", 0.45)):
        assert sum(r["mix_tokens"] * r["mix_probability"] for r in out if r[dim] == name) / total == pytest.approx(share, abs=1e-6)
    assert max(r["mix_weight"] for r in out) == pytest.approx(1 / 0.6)


def test_mixing_with_too_few_words(spark):
    """A category that cannot reach its target is taken whole and the other keeps its own target."""
    docs = spark.createDataFrame([(i, "w " * 100, "en" if i % 10 else "es", "s") for i in range(100)], "doc_id long, text string, lang string, source string")
    out = op5_mixing.mixed(docs, {"source": 1.0, "lang": {"en": 0.5, "es": 0.5}, "topic": 1.0}, keep=0.5).collect()
    assert {r["mix_probability"] for r in out if r["lang"] == "es"} == {1.0}
    assert all(r["mix_kept"] for r in out if r["lang"] == "es")


def test_mixing_awkward(spark):
    docs = awkward(spark)
    out = op5_mixing.mixed(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == 13 and op5_mixing.mixed(empty(spark)).collect() == []
    assert {r["mix_topic"] for r in rows if not (r["text"] or "").strip()} == {"empty"} and all(r["mix_kept"] is not None for r in rows)


# ---------------------------------------------------------------- 10 search


def plain_top(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted(((sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q and len(x) == len(v)), key=lambda s: (-s[0], s[1]))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run_top(spark, rows, kind="float"):
    """The rows found with a broadcast; a grid of small blocks must find the same."""
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("nth", F.lit(3))
    asked = table.where("vec_id % 50 = 0")
    found = [op10_topk.top_k(table, asked, **sizes).collect() for sizes in ({}, {"broadcast_bytes": 0, "block_bytes": 4096})]
    ways = [sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) for rows in found]
    assert ways[0] == ways[1]
    return ways[0]


@pytest.mark.parametrize("dims", [1, 16, 17, 64])
def test_search(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(300, dims)).astype(np.float32)
    base[100:130] = base[7]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    assert run_top(spark, rows) == plain_top(rows)


def test_search_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (50, [3.0, -1.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 1.0]), (50, [2.0, -1.0]), (150, [1.0])]
    assert run_top(spark, rows) == plain_top(rows)
    assert run_top(spark, rows[2:6]) == []
    big = [(i, [float(2**16 * (i + 1)), float(-(2**15) * i)]) for i in range(60)]
    assert run_top(spark, big, "double") == plain_top(big)


# ---------------------------------------------------------------- pipeline


def folders(spark):
    path = Path(common.shared_dir(spark).removeprefix("file://")) / "corpusloom"
    return {p.name for p in path.iterdir()} if path.exists() else set()


def test_scratch_tables_go(spark):
    before = folders(spark)
    with common.scratch(spark):
        kept = common.written(common.written(spark.range(3), "gone"), "kept", lasting=True)
    assert sorted(r[0] for r in kept.collect()) == [0, 1, 2]
    assert [name.rpartition("-")[0] for name in folders(spark) - before] == ["kept"]
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.written(spark.range(3), "gone")
        1 / 0
    assert len(folders(spark) - before) == 1


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = folders(spark)
    got = corpus_pipeline.run(spark, sf)
    assert [name.rpartition("-")[0] for name in folders(spark) - before] == ["stage-sharding"]
    assert got.columns == [*docs.columns, "shard"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = op1_quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    mark = np.zeros(1 << op1_quality.BITS, bool)
    own = op1_quality.Model(model.weights.astype(np.float32), model.squares.astype(np.float32), model.bias, model.slope, model.offset)
    left = [i for i in sorted(rows) if own.score(op1_quality.features(rows[i]["text"], mark)) >= op1_quality.THRESHOLD]
    component = plain_components([(i, rows[i]["text"]) for i in left], 5)
    left = [i for i in left if component[i] == i]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = op9_decontaminate.SeedIndex([i for i, _ in bench], [t for _, t in bench], 13, 0.8, 5)
    left = [i for i in left if not index.overlaps(op9_decontaminate.tokens_of(rows[i]["text"]))]
    mix = op5_mixing.mixed(docs.where(F.col("doc_id").isin(left)))
    want = sorted(r["doc_id"] for r in mix.where("mix_kept").collect())
    placed = got.collect()
    assert sorted(r["doc_id"] for r in placed) == want
    shard_of = {r["doc_id"]: r["shard"] for r in QUERIES["op4_shard_placement"](spark, sf).collect()}
    for r in placed:
        assert r["shard"] == shard_of[r["doc_id"]] and all(r[c] == rows[r["doc_id"]][c] for c in docs.columns)


def test_stages_decide_rows_not_ids(spark, tmp_path):
    """An id with several texts loses only the texts that are copies or leaks; rows without an id count too."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a") + " end"), (5, text("b")), (7, text("b") + " end"), (7, text("c")), (7, text("d")), (7, text("d")), (None, text("c")), (None, text("e")), (None, text("e")), (None, text("e") + " end"), (8, text("f"))]
    docs = documents(spark, rows)
    left = corpus_pipeline.near_duplicate(spark, docs, str(tmp_path)).collect()
    got = sorted(((r["doc_id"] or 0, r["text"].removesuffix(" end")[0]) for r in left))
    assert got == [(0, "e"), (1, "a"), (5, "b"), (7, "c"), (7, "d"), (8, "f")]
    spark.createDataFrame([(1, text("c")[:100])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted((i or 0, t) for i, t in rows if t[0] != "c")


@pytest.mark.parametrize("stage", range(5))
def test_stages_awkward(spark, sf, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = awkward(spark)
    out = run(spark, docs, sf)
    assert out.columns == docs.columns + ["shard"] * (stage == 4) and out.count() <= docs.count()
    assert run(spark, empty(spark), sf).count() == 0
