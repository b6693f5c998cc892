"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive tokens; only the tokens under a 1 enter the hash, so
a substituted token under a 0 does not hide an overlap. MASKS find every overlap of 13 and more
tokens with up to two substitutions; shorter ones, and those with more substitutions, have a family
of masks for their length and number of substitutions (tests try all placements). Hashes of the
benchmark join hashes of the documents; around each hit the aligned tokens are compared, and the overlap counts when some window
of ``window`` aligned tokens (the whole item, if shorter) has at least ``share`` of them equal.

The benchmark is dealt into blocks of bounded size; each block is broadcast once and held against
all rows, so no text leaves its task and no pair is shuffled. A benchmark of up to BLOCK_BYTES, which
is more than a hundred thousand questions, takes one pass over the corpus.

Hits become alignments (item, shift) in steps of bounded size, and equal alignments are kept once, so
a token that repeats in a text and in an item costs array work, not a row for each pair of places.

Rows: null or empty texts and items with fewer than ``least`` tokens match nothing (one or two words
would take out most of a corpus); repeated rows give repeated results only if their ids differ; rows
and items with a null id are compared like others and carry a null id; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import WordHashes, mix

MASKS = ("11101011", "110100111")
MASKS_SPAN, MASKS_ERRORS = 13, 2  # what MASKS cover
LEAST_WEIGHT = 4  # tokens that a mask of a family hashes, where the length has as many
WINDOW, SHARE, LEAST = 13, 0.8, 5
BLOCK_BYTES = 32 << 20  # of benchmark text in one broadcast, on average; its seeds take about 10 times as much
HITS_AT_ONCE = 1 << 20  # hits that are turned into alignments in one step
_TABLE_BITS = 22
_HASHES = WordHashes()
_TOKEN = re.compile(r"\w+")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and underscores."""
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter((_HASHES[w.encode("utf-8", "surrogatepass")] for w in words), np.uint64, len(words))


def least_equal(need: int, share: float) -> int:
    return math.ceil(share * need - 1e-9)


def masks_for(need: int, errors: int) -> tuple[str, ...]:
    """Masks that find need aligned tokens with up to errors substitutions, wherever these are.

    The tokens are cut into blocks; each mask leaves out ``errors`` of the blocks, so one of them
    leaves out every block with a substitution. The fewest blocks that leave enough tokens are taken.
    """
    if need >= MASKS_SPAN and errors <= MASKS_ERRORS:
        return MASKS
    for blocks in range(errors + 1, need + 1):
        block = [j * blocks // need for j in range(need)]
        masks = ["".join("01"[b not in out] for b in block) for out in combinations(range(blocks), errors)]
        if min(m.count("1") for m in masks) >= min(LEAST_WEIGHT, need - errors):
            return tuple(masks)
    return ("0" * need,)  # nothing needs to agree


def _seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, np.uint64(int(mask, 2) * 64 + len(mask)))
    for j, sign in enumerate(mask):
        if sign == "1":
            acc = acc * _SPREAD + tokens[j : j + n]
            acc ^= acc >> np.uint64(31)
    return mix(acc)


class SeedIndex:
    """Seeds of a bounded block of benchmark items, sorted by hash."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int, share: float, least: int):
        self.window, self.share = window, share
        self.ids, self.tokens = [], []
        for i, t in zip(ids, texts):
            tokens = tokens_of(t)
            if len(tokens) >= least:
                self.ids.append(i)
                self.tokens.append(tokens)
        users: dict[str, list[int]] = {}  # mask: its items
        for i, tokens in enumerate(self.tokens):
            need = min(window, len(tokens))
            for mask in masks_for(need, need - least_equal(need, share)):
                users.setdefault(mask, []).append(i)
        self.masks = sorted(users)
        hashes = [_seed_hashes(self.tokens[i], mask) for mask in self.masks for i in users[mask]]
        owners = [i for mask in self.masks for i in users[mask]]
        self.hash = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.repeat(np.array(owners, np.int32), [len(h) for h in hashes])[order]
        self.at = np.concatenate([np.empty(0, np.int32), *(np.arange(len(h), dtype=np.int32) for h in hashes)])[order]
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self.hash >> np.uint64(64 - _TABLE_BITS)] = True

    def _aligned(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (item << 32) + shift + 2**31 of all hits, in order."""
        found = [np.empty(0, np.int64)]
        for mask in self.masks:
            h = _seed_hashes(tokens, mask)
            spots = np.flatnonzero(self.seen[h >> np.uint64(64 - _TABLE_BITS)])
            if not len(spots):
                continue
            lo, hi = np.searchsorted(self.hash, h[spots], "left"), np.searchsorted(self.hash, h[spots], "right")
            spots, lo, n = spots[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            step = np.cumsum(n) // HITS_AT_ONCE
            for own in (step == x for x in np.unique(step)):
                many = n[own]
                places = np.repeat(lo[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                shifts = np.repeat(spots[own], many) - self.at[places]
                found.append(np.unique((self.item[places].astype(np.int64) << 32) + shifts + (1 << 31)))
        return np.unique(np.concatenate(found))

    def overlaps(self, tokens: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item_id, doc_start, item_start, n_tokens, n_equal) of the best overlap with each item."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for key in self._aligned(tokens).tolist():
            i, shift = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
            item = self.tokens[i]
            first, last = max(0, -shift), min(len(item), len(tokens) - shift)
            need = min(self.window, len(item))
            if last - first < need:
                continue
            equal = item[first:last] == tokens[first + shift : last + shift]
            sums = np.concatenate(([0], np.cumsum(equal)))
            inside = sums[need:] - sums[:-need]
            good = np.flatnonzero(inside >= least_equal(need, self.share))
            if len(good):
                start, end = int(good[0]), int(good[-1]) + need
                row = (first + start + shift, first + start, end - start, int(sums[end] - sums[start]))
                if i not in best or row[3] > best[i][3]:
                    best[i] = row
        return [(self.ids[i], *row) for i, row in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """Broadcasts of (item_id, text), each of a bounded block of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(((r["item_id"], r["text"]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, n_equal: a row for each document and item that overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shared in _blocks(benchmark):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = SeedIndex([i for i, _ in shared.value], [t for _, t in shared.value], window, share, least)
            for rows in batches:
                out = [(d, *x) for d, t in zip(rows["doc_id"], rows["text"]) for x in index.overlaps(tokens_of(t))]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        got = docs.mapInPandas(run, "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long")
        found = got if found is None else found.union(got)
    return found


def _is_clean(text: Column, shared: Broadcast, window: int, share: float, least: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = SeedIndex([i for i, _ in shared.value], [t for _, t in shared.value], window, share, least)
        for texts in batches:
            yield pd.Series([not index.overlaps(tokens_of(t)) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")(text.cast("string"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """docs without the rows whose own text has an overlap with the benchmark, whatever their id is."""
    for shared in _blocks(benchmark):
        docs = docs.where(_is_clean(F.col("text"), shared, window, share, least))
    return docs


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that overlap with the benchmark; rows with a null id stay."""
    return clean_rows(docs.where("doc_id is not null"), benchmark, **options).unionByName(docs.where("doc_id is null"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
