"""Tables whose further columns have the names that operators use inside and give to their results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import op1_quality, op2_minhash, op3_secrets, op4_sharding, op5_mixing, op6_tables, op7_urls, op8_html, op9_decontaminate, op10_topk
from corpusloom.llm.common import free_name, new_folder

NAMES = """quality_score score held_out predicted n_shingles component_id kept d1 d2 chosen rep comp node digest one k_id k1 k2 n some base_spans secret_spans model_spans
slot shard probe salt mix_topic mix_tokens mix_weight mix_probability mix_kept c_source c_lang c_topic tokens topic w u bound before host path rule block_probability verdict main_text
item_id doc_start v nth rank c q query_id vec_id_ start n_tokens ids_crc32 key band sketch""".split()
TEXTS = ["one two three four five six seven", "one two three four five six seven", "password = abcdef123", "", None, "x | y"]


def crowded(df):
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES if n not in df.columns})


@pytest.fixture
def docs(spark):
    return crowded(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long"))


def kept_as_they_were(df, out, key):
    assert out.columns[: len(df.columns)] == df.columns
    own = {r[key]: r.asDict() for r in df.collect()}
    rows = out.collect()
    assert len(rows) == len(own)
    for r in rows:
        assert all(r[c] == own[r[key]][c] for c in df.columns)
    return rows


def test_results_beside_them(spark, docs):
    labels = crowded(spark.createDataFrame([(0, 1, 0), (2, 0, 0), (3, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    scored = op1_quality.score(docs, op1_quality.learn(docs, labels))
    assert all(0 <= r[free_name(docs, "quality_score")] <= 1 for r in kept_as_they_were(docs, scored, "doc_id"))
    placed = op4_sharding.with_shard(docs)
    assert all(0 <= r["_shard"] < op4_sharding.SHARDS for r in kept_as_they_were(docs, placed, "doc_id"))
    path = new_folder(spark, "shards")
    op4_sharding.write_shards(docs, path, splits=2)
    assert spark.read.parquet(path).count() == len(TEXTS)
    mixed = op5_mixing.mixed(docs)
    assert {r["_mix_topic"] for r in kept_as_they_were(docs, mixed, "doc_id")} == {"prose", "empty", "tabular"}
    pages = crowded(spark.createDataFrame([(1, "http://a.net/es/x", "<p>t</p>"), (2, None, None)], "page_id long, url string, html string"))
    assert {r["_verdict"] for r in kept_as_they_were(pages, op7_urls.judged(pages), "page_id")} == {"allow", "block"}
    assert [r["_main_text"] for r in kept_as_they_were(pages, op8_html.with_main_text(pages), "page_id")] == ["t", ""]


def test_results_without_them(spark, docs):
    assert len(op2_minhash.near_duplicates(docs).collect()) == len(TEXTS)
    assert op3_secrets.with_spans(docs.select("doc_id", "text"), [0.0] * 66 * 66).count() == len(TEXTS)
    shards = op6_tables.write_tables(docs, new_folder(spark, "tokens"), pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert op6_tables.read_tables(shards).count() == len(TEXTS)
    bench = crowded(spark.createDataFrame([(1, TEXTS[0])], "item_id long, text string"))
    assert op9_decontaminate.contaminated(docs, bench).count() == 2 and op9_decontaminate.clean_rows(docs, bench).columns == docs.columns
    vectors = crowded(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>"))
    assert op10_topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).count() == 10
    assert op10_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), broadcast_bytes=0, block_bytes=64).count() == 10


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, sf, docs, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    own = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert all(r[c] == own[r["doc_id"]][c] for r in out.collect() for c in docs.columns)
