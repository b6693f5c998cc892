"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Each text becomes a set of word shingles (64-bit hashes), a 128-bit set digest and a sketch of
   bands * rows coordinates (sketch.py), 16 bits kept of each coordinate.
2. Texts with equal sets form one class with a number of its own (rep), whatever the ids of its
   rows are. Only classes go on, so copies never meet in pairs.
3. Bands of the sketch are bucket keys. Buckets with the same members in several bands count once.
   In every bucket each member is checked against the bucket's smallest class on full sets.
4. Components of these links are found. Where a bucket still holds several components, its members
   are checked against each other in blocks: every pair of different components whose sizes and
   sketches allow the similarity is confirmed on full sets. Nothing is capped: large buckets are
   dealt out as pairs of blocks, and what has to be confirmed is dealt again by the bytes of its
   sets, so each unit of work is bounded in rows and in bytes.
5. Components of all links give the result.

A pair of similarity 0.8 is missed by all 32 bands of 5 rows with probability 3e-6, and by the
sketch bound of 0.64 with probability under 1e-6; a pair of 0.85 with under 1e-8.

Rows: a null or blank text has an empty set and is linked with nothing; a null doc_id gets a null
component and is kept, but its text links others; rows that repeat a doc_id with different texts
belong each to its own text's component, rows that repeat both are decided alike; other columns are
ignored. Of a component the text with the smallest doc_id (then the smallest digest) is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, small_side, table, written
from .components import connected_components
from .shingles import WordHashes, shingle_set, words_of
from .sketch import Sketcher

BANDS, ROWS = 32, 5
SKETCH_BOUND = 0.64  # least share of agreeing coordinates; 5 standard deviations under 0.8
BLOCK = 2048  # members of a bucket in one block
SPLITS = 256  # least number of parts of the members that are checked against one pivot
SKETCH_PACK, SET_PACK = 2 << 20, 8 << 20  # bytes of sketches and of sets that one group of checks holds, on average
MOST_TASKS = 4096
_HASHES = WordHashes()


def _digest(s: np.ndarray) -> tuple[int, int]:
    spread = s * np.uint64(0x9FB21C651E98DF25)
    spread ^= spread >> np.uint64(32)
    digest = (int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(spread * (s | np.uint64(1)))))
    return tuple(x - (1 << 64) if x >> 63 else x for x in digest)


def digest_of(text: Column, k: int) -> Column:
    """(d1, d2) of the text's shingle set; both null for an empty set."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = (shingle_set(words_of(x), k, _HASHES) for x in texts)
            yield pd.DataFrame([_digest(s) if len(s) else (None, None) for s in sets], columns=["d1", "d2"], dtype="Int64")

    return F.pandas_udf(run, "d1 long, d2 long")(text.cast("string"))


def _sketched(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(BANDS, ROWS)
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                s = shingle_set(words_of(text), k, _HASHES)
                if len(s):
                    d1, d2 = _digest(s)
                    out.append((doc_id, len(s), d1, d2, sketcher.sketch(s).astype("<u2").tobytes()))
                else:
                    out.append((doc_id, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "d1", "d2", "sketch"]).astype({"doc_id": "Int64", "d1": "Int64", "d2": "Int64"})

    return run


def _sets(k: int):
    """The digest and the set of each text that has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets = (shingle_set(words_of(text), k, _HASHES) for text in rows["text"])
            yield pd.DataFrame([(*_digest(s), s.tobytes()) for s in sets if len(s)], columns=["d1", "d2", "shingles"]).astype({"d1": "int64", "d2": "int64"})

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = up = self.get(up, up)
            x = up
        return x


def _fitting(unit: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a unit the later ones that may be linked: other component, sizes and sketches fit.

    Members of side 0 are held against each other, side 1 against side 2; in a unit of two parts only
    members of different parts. Within buckets (band >= 0) a pair counts in the first band that both share.
    """
    comps, side, sizes, part = (unit[c].to_numpy() for c in ("comp", "side", "n", "part"))
    coords = np.frombuffer(b"".join(unit["sketch"]), "<u2").reshape(len(unit), BANDS * ROWS)
    band, places, two = int(unit["band"].iat[0]), np.arange(len(unit)), bool((part != part[0]).any())
    for i in np.flatnonzero(side < 2):
        later = side == 2 if side[i] else places > i
        if two:
            later = later & (part != part[i])
        fits = later & (comps != comps[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(fits)
        if len(others):
            same = coords[others] == coords[i]
            keep = same.mean(axis=1) >= SKETCH_BOUND
            if band >= 0:
                keep &= same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) >= band
            yield i, others[keep]


def _fitting_members(percent: int):
    """The rows of each unit that have a partner to be confirmed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, unit in rows.groupby("unit", sort=False):
            needed = np.zeros(len(unit), bool)
            for i, others in _fitting(unit, percent):
                if len(others):
                    needed[i] = needed[others] = True
            kept.append(unit[needed])
        return pd.concat(kept)[["unit", "side", "band", "rep", "comp", "n", "sketch"]]

    return run


def _confirmed(percent: int):
    """Confirms links on full sets and returns those that join two components of their pack."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, forest = [], _Forest()
        for _, unit in rows.groupby("unit", sort=False):
            reps, comps = unit["rep"].to_numpy(), unit["comp"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in unit["shingles"]]
            for i, others in _fitting(unit, percent):
                for j in others:
                    x, y = forest.root(comps[i]), forest.root(comps[j])
                    if x != y and _linked(sets[i], sets[j], percent):
                        forest[max(x, y)] = min(x, y)
                        found.append((reps[i], reps[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _packs(units: DataFrame, size: Column, pack_bytes: int) -> int:
    return max(1, math.ceil((units.agg(F.sum(size)).first()[0] or 0) / pack_bytes))


def _by_pack(rows: DataFrame, packs: int):
    """rows grouped by pack, over as many tasks as there are packs; a given number is not coalesced."""
    return rows.repartition(min(MOST_TASKS, packs), "pack").groupBy("pack")


def _fitting_units(units: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows (unit, side, band, rep, comp) that have a partner to be confirmed, with n and sketch."""
    packs = _packs(units, F.lit(2 * BANDS * ROWS), SKETCH_PACK)
    light = units.withColumn("pack", F.pmod(F.xxhash64("unit"), F.lit(packs))).withColumn("part", F.lit(0)).join(sketches, "rep")
    fitting = _by_pack(light, packs).applyInPandas(_fitting_members(percent), "unit long, side int, band int, rep long, comp long, n long, sketch binary")
    return written(fitting, "fitting")


def _with_large(units: DataFrame, size: Column, most: int) -> DataFrame:
    """units with a column large: the bytes of the unit, 0 if it has no more than half of ``most``."""
    sizes = units.groupBy("unit").agg(F.sum(size).alias("large")).where(F.col("large") > most / 2)
    return joined(units, written(sizes, "large"), ["unit"], F.col("rep"), "left").withColumn("large", F.coalesce("large", F.lit(0)))


def _in_parts(units: DataFrame, most: int) -> DataFrame:
    """units whose sets have more than ``most`` bytes as units of two parts, every pair of parts once."""
    dealt = _with_large(units, 8 * F.col("n"), most).withColumn("parts", F.greatest(F.ceil(2 * F.col("large") / most), F.lit(1)).cast("int")).drop("large")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.when(F.col("parts") > 1, F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.col("unit"))
    return dealt.withColumn("unit", unit).drop("parts", "other")


def _links(units: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links found among the rows of _fitting_units, on full shingle sets of their texts (doc_id, text)."""
    needed = written(classes.select("rep", "doc_id", "d1", "d2").join(units.select("rep").distinct(), "rep", "left_semi"), "needed")
    ids = written(needed.where("doc_id is not null").select("doc_id").distinct(), "ids")
    found = texts.join(small_side(ids), "doc_id", "left_semi")
    if not needed.where("doc_id is null").isEmpty():
        found = found.union(texts.where("doc_id is null"))
    sets = found.select("text").mapInPandas(_sets(k), "d1 long, d2 long, shingles binary")
    sets = sets.join(small_side(needed.select("rep", "d1", "d2")), ["d1", "d2"]).select("rep", "shingles").dropDuplicates(["rep"])
    parts, size = written(_in_parts(units, SET_PACK), "parts"), 8 * F.col("n") + 2 * BANDS * ROWS
    packs = _packs(parts, size, SET_PACK)
    own = F.when(F.col("large") > 0, F.xxhash64("unit"))  # a large unit is a pack of its own
    full = _with_large(parts, size, SET_PACK).withColumn("pack", F.coalesce(own, F.pmod(F.xxhash64("unit"), F.lit(packs)))).drop("large").join(sets, "rep")
    return written(_by_pack(full, 2 * packs).applyInPandas(_confirmed(percent), "u long, v long"), "links")


def decided(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, d1, d2, component_id, chosen for every row of docs (doc_id, text).

    (d1, d2) is the digest of the row's set. chosen: the row has the id and the text that its
    component keeps; component_id is null where no row of the component has an id.

    Links two texts when 100 * |A & B| >= percent * |A | B| over their k-word shingle sets. percent
    is at least 80: the bands and the sketch bound are chosen for that.
    """
    if percent < 80:
        raise ValueError("the banding is chosen for similarities of 0.8 and more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInPandas(_sketched(k), "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"), "sketches")

    classes = written(
        rows.where("d1 is not null").groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes",
    )
    width = 2 * ROWS
    keyed = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * width + 1, F.lit(width)))).alias("band", "part"))
    keyed = keyed.select("rep", "band", F.xxhash64("band", "part").alias("key"))
    buckets = (
        keyed.groupBy("key").agg(F.count("rep").alias("cnt"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rep")).alias("sig"))
        .where("cnt > 1").groupBy("sig", "cnt", "lo", "hi").agg(F.min_by("key", "band").alias("key"))
    )
    buckets = written(buckets.select("key", "cnt", "lo", "hi"), "buckets")
    crowded = buckets.where("cnt > 2").select("key", "cnt", "lo")
    members = written(joined(keyed, crowded, ["key"], F.col("rep")), "members")

    star = members.where("rep != lo").select("lo", "rep").union(buckets.where("cnt = 2").select("lo", F.col("hi").alias("rep"))).distinct()
    star = written(star, "star")
    active = small_side(written(star.select("rep").union(star.select("lo")).distinct(), "active"))
    sketches = written(classes.select("rep", "n", "sketch").join(active, "rep", "left_semi"), "sketches")

    widest = star.groupBy("lo").agg(F.count(F.lit(1)).alias("cnt")).agg(F.max("cnt")).first()[0] or 0
    dealt = star.withColumn("unit", F.xxhash64("lo", F.pmod(F.xxhash64("rep"), F.lit(max(SPLITS, math.ceil(widest / BLOCK))))))
    units = dealt.select("unit", F.lit(2).alias("side"), F.lit(-1).alias("band"), "rep", F.col("rep").alias("comp")).union(
        dealt.select("unit", "lo").distinct().select("unit", F.lit(1), F.lit(-1), "lo", "lo")
    )
    links = _links(_fitting_units(units, sketches, percent), classes, docs, k, percent)
    comps = connected_components(links)

    labelled = written(
        members.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "band", "cnt", "rep", F.coalesce("component", "rep").alias("comp")), "labelled",
    )
    torn = written(labelled.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key"), "torn")
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("int")
    left = joined(labelled, torn, ["key"], F.col("rep")).select("key", "band", "rep", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    units = left.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), side.alias("side"), "band", "rep", "comp")
    more = _links(_fitting_units(units, sketches, percent), classes, docs, k, percent)

    comps = connected_components(links.union(more)).withColumnRenamed("node", "rep")
    several = classes.join(comps, "rep", "left").where("component is not null or copies > 1")
    several = written(several.select("d1", "d2", "doc_id", F.coalesce("component", "rep").alias("comp")), "several")
    first = several.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")).alias("first"))
    found = joined(several, written(first, "first"), ["comp"], F.col("d1"))
    leads = (F.col("d1") == F.col("first.d1")) & (F.col("d2") == F.col("first.d2"))
    found = written(found.select("d1", "d2", F.col("first.doc_id").alias("component_id"), leads.alias("leads")), "found")
    out = joined(rows.drop("sketch"), found, ["d1", "d2"], F.monotonically_increasing_id(), "left")
    alone = F.col("leads").isNull()  # no copies and no links
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "d1", "d2", component.alias("component_id"), (alone | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id")))).alias("chosen"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); see decided()."""
    named = F.col("doc_id").isNotNull()
    return decided(docs, k, percent).select("doc_id", "n_shingles", F.when(named, F.col("component_id")).alias("component_id"), (~named | F.col("chosen")).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
