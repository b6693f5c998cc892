"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell's weight starts as its number of
words. Each round scales the weights to the target share of every source, then of every language,
then of every topic, until no cell moves by more than ``tolerance`` of its weight. A document is then sampled
with probability keep * (fitted weight / words) of its cell against a hash of its id.

No cell can give more words than it has, so its weight is bounded by words / (keep * all words)
within the fit: margins are sums of the bounded weights, and the unbounded weight of a category's
other cells grows until they make up for the ones at their bound. Where targets need more words than
there are, all cells of the short category end at their bound and the rest is at its targets; the
sample is smaller by what is missing. op5_source_mixing keeps to its SQL, which fits without the
bound and clips afterwards; op5_bounded_mixing and the pipeline fit with it.

Targets: for each of the three a number a gives every category the share (its own share) ** a,
scaled to 1, so 1 keeps and 0 levels the observed shares; a dictionary gives raw weights, and
categories that it does not list enter with their observed share.

Everything is DataFrame code: one aggregation over the corpus to cells, windows over the cells, one
join of the few cells back to the rows. Sizes of the joined side are Spark's to check.

Rows: null source or language is a category of its own; null and blank texts have no words, topic
``empty`` and probability ``keep``; a null id is sampled by the hash of its text; repeated rows are
sampled alike; further columns stay as they are.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, table, text_or_empty, written

DIMENSIONS = ("source", "lang", "topic")
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}, "topic": 0.7}
KEEP, TOLERANCE, ROUNDS, AT_ONCE = 0.5, 1e-9, 60, 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from plain signs in the text; the first rule that fits counts."""
    return (
        F.when(text.contains("Licensed under") | text.contains("Copyright"), "licence")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("@"), "contact")
        .when(~text.rlike(r"[^\x20\x09-\x0D]"), "empty")
        .otherwise("prose")
    )


def _chance(doc_id: Column, text: Column) -> Column:
    name = F.coalesce(F.concat(F.lit("mix|"), doc_id.cast("string")), F.concat(F.lit("text|"), text))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _total(df: DataFrame, column: str) -> float:
    """The sum of a column as one number; 1 for an empty table, whose shares nobody asks for."""
    return float(df.agg(F.sum(column)).first()[0] or 1)


def _with_target(cells: DataFrame, dim: str, target: float | dict[str, float], total: float) -> DataFrame:
    """cells with the column t_<dim>: the share that the cell's category shall have."""
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("own"))
    share = F.col("own") / F.lit(total)
    if isinstance(target, dict):
        named = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in sorted(target.items())))
        own = own.withColumn("raw", F.coalesce(F.try_element_at(named, F.coalesce(dim, F.lit(""))), share))
    else:
        own = own.withColumn("raw", F.when(F.col("own") > 0, F.pow(share, F.lit(float(target)))).otherwise(0.0))
    own = own.withColumn(f"t_{dim}", F.col("raw") / F.lit(_total(own, "raw")))
    own = own.select(F.col(dim).alias("category"), f"t_{dim}")
    return cells.join(own, F.col(dim).eqNullSafe(F.col("category"))).drop("category")


def fitted_cells(cells: DataFrame, targets: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE, keep: float | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with t_<dimension> and the fitted weight w.

    w sums to 1, or to less where keep is given and its bound rules out the targets.
    """
    cells = cells.where("tokens > 0")
    total = _total(cells, "tokens")
    for dim in DIMENSIONS:
        cells = _with_target(cells, dim, targets[dim], total)
    share = F.col("tokens") / F.lit(total)
    bound = F.lit(float("inf")) if keep is None else share / F.lit(float(keep))
    now = written(cells.withColumns({"u": share if keep is not None else F.col("tokens").cast("double"), "bound": bound}), "cells")
    w = F.least("u", "bound")
    for _ in range(0, rounds, AT_ONCE):
        now = now.withColumn("before", w)
        for dim in DIMENSIONS * AT_ONCE:
            now = now.withColumn("u", F.col("u") * F.col(f"t_{dim}") / F.sum(w).over(Window.partitionBy(dim)))
        seen = Observation()  # counted while the round is written, so that a round is one job
        now = now.observe(seen, F.max(F.abs(w / F.col("before") - 1)).alias("moved")).drop("before")
        now = written(now, "cells")
        if (seen.get["moved"] or 0.0) <= tolerance:
            break
    return now.withColumn("w", w).drop("u", "bound")


def mixed(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, bounded: bool = True) -> DataFrame:
    """docs with more columns: mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept, each under
    free_name(docs, its name), so that columns which docs has already stay as they are.

    mix_weight is the fitted weight of a word of the cell relative to its own: 1 leaves it as it is.
    Without ``bounded`` it may be above 1 / keep, and the clipped probability misses the targets.
    """
    targets = TARGETS | (targets or {})
    text = text_or_empty("text")
    topic, tokens, weight, chance, kept = (free_name(docs, f"mix_{c}") for c in ("topic", "tokens", "weight", "probability", "kept"))
    marked = docs.withColumns({topic: topic_of(text), tokens: n_words(text)})
    keys = (F.col("source").alias("source"), F.col("lang").alias("lang"), F.col(topic).alias("topic"))
    cells = written(marked.groupBy(*keys).agg(F.sum(tokens).alias("tokens")), "cells")
    fitted = fitted_cells(cells, targets, ROUNDS, TOLERANCE, keep if bounded else None)
    names = [free_name(marked, f"c_{c}") for c in DIMENSIONS]
    found = (F.col("w") * F.lit(_total(fitted, "tokens")) / F.col("tokens")).alias(weight)
    ratio = written(fitted.select(*(F.col(c).alias(n) for c, n in zip(DIMENSIONS, names)), found), "ratios")
    on = F.col("source").eqNullSafe(F.col(names[0])) & F.col("lang").eqNullSafe(F.col(names[1])) & (F.col(topic) == F.col(names[2]))
    out = marked.join(ratio, on, "left").drop(*names)
    out = out.withColumn(weight, F.coalesce(weight, F.lit(1.0)))
    out = out.withColumn(chance, F.least(F.lit(1.0), F.lit(float(keep)) * F.col(weight)))
    return out.withColumn(kept, _chance(F.col("doc_id"), text_or_empty("text")) < F.col(chance))


def _mixing(spark: SparkSession, sf_dir: str, bounded: bool) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), bounded=bounded)
    return out.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir, bounded=False)


def op5_bounded_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing(spark, sf_dir, bounded=True)


def _target_sql(dim: str, target: float | dict[str, float]) -> str:
    if isinstance(target, dict):
        whens = " ".join(f"when '{k}' then {float(v)!r}" for k, v in sorted(target.items()))
        raw = f"coalesce(case {dim} {whens} end, own / sum(own) over ())"
    else:
        raw = f"case when own > 0 then pow(own / sum(own) over (), {float(target)!r}) else 0 end"
    return f"select {dim} as category, raw / sum(raw) over () as t from (select *, {raw} as raw from (select {dim}, sum(tokens)::double as own from cells where tokens > 0 group by {dim}))"


def _oracle_sql(bounded: bool) -> str:
    w, begin = ("least(w, bound)", "tokens / sum(tokens) over ()") if bounded else ("w", "tokens::double")
    steps = "select source, lang, topic, tokens, t_source, t_lang, t_topic, bound, w, i from fit"
    for dim in DIMENSIONS:
        steps = f"select * replace (w * t_{dim} / sum({w}) over (partition by {dim}) as w) from ({steps})"
    return f"""
with recursive d as (
  select doc_id, source, lang, coalesce(text, '') as x from documents
), marked as (
  select doc_id, source, lang, x, len(regexp_extract_all(x, '[^ \\t-\\r]+'))::bigint as tokens,
    case when contains(x, 'Licensed under') or contains(x, 'Copyright') then 'licence' when contains(x, ' | ') then 'tabular'
      when contains(x, '@') then 'contact' when not regexp_matches(x, '[^ \\t-\\r]') then 'empty' else 'prose' end as topic
  from d
), cells as (
  select source, lang, topic, sum(tokens)::bigint as tokens from marked group by all
), begun as (
  select c.*, s.t as t_source, l.t as t_lang, p.t as t_topic, tokens / sum(tokens) over () / {KEEP} as bound, {begin} as w
  from cells c join ({_target_sql("source", TARGETS["source"])}) s on c.source is not distinct from s.category
  join ({_target_sql("lang", TARGETS["lang"])}) l on c.lang is not distinct from l.category
  join ({_target_sql("topic", TARGETS["topic"])}) p on c.topic is not distinct from p.category where tokens > 0
), fit as (
  select *, 0 as i from begun
  union all
  select * replace (i + 1 as i) from ({steps}) where i < {ROUNDS}
), ratio as (
  select source, lang, topic, {w} * sum(tokens) over () / tokens as weight from fit where i = {ROUNDS}
), joined as (
  select m.doc_id, m.x, m.topic, m.tokens, coalesce(r.weight, 1.0) as weight, least(1.0, {KEEP} * coalesce(r.weight, 1.0)) as probability
  from marked m left join ratio r on m.source is not distinct from r.source and m.lang is not distinct from r.lang and m.topic = r.topic
)
select doc_id, topic, tokens, round(weight, 6) as weight, round(probability, 6) as probability,
  ('0x' || substr(md5(coalesce('mix|' || doc_id, 'text|' || x)), 1, 8))::bigint / 4294967296.0 < probability as kept
from joined
"""


SQL, BOUNDED_SQL = _oracle_sql(False), _oracle_sql(True)
