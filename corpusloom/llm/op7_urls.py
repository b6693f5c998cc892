"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table (labelled() by default: names in host
shapes that both kinds share), by full gradient steps with L2 shrinkage. Host and path n-grams have salts of their own. Rules are tried
longest first: a rule fits its host and all subdomains when the path starts with the rule's path.

Rows: a null url or one without :// has empty host and path, fits no rule and gets the verdict that
the model's intercept gives; empty hosts and paths alike; repeated rows give repeated results; other
columns stay as they are: where pages has a column of one of the new names, the new one has an
underscore more (free_name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

BITS = 15
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table: names that adverts, betting, adult, pill and link farms give to hosts, and other names.
BLOCKED = """best-casino online-casino-bonus casinoroyal live-casino vegas-casino bet-free-now sports-bets freebet-tips bestbets betting-odds win-big-jackpot poker-win
free-lottery big-win-slots free-spins xxx-adult adult-cams adult-dating hot-adult xadult adult-video-x pills-cheap-rx buy-cheap-meds cheap-replica cheap-meds
pills-online diet-pills rx-pills cheap-loans-now ad-track ads-server click-track ads-network trackads my-ads ad-pixel spam-links link-farm seo-farm spamhost
backlink-farm spam-mail content-farm""".split()
ALLOWED = """university library news museum docs weather recipes gardening history encyclopedia school city-council science orchestra forum travel books health
open-source letters poetry geology bridges harbour museum-shop kitchen climate parliament orchard cathedral philosophy theatre thermal tenth northern thinking station nation other therapy athletics weather-station teachers thesis farming-today
track-and-field trains alphabet winter-hiking address-book loading-dock winery freedom-of-speech batteries tables""".split()
#: Hosts and paths that both kinds have; each name stands in three of them.
SHAPES = (
    "{}.example/", "www.{}.example.com/en/14", "{}.example.org/de/3.html", "m.{}.example.net/fr/902", "blog.{}.example.com/es/77/", "{}.example.com/en/5310",
    "www.{}.example.net/de/8", "m.{}.example.org/en/461.html", "blog.{}.example.net/fr/25", "www.{}.example.org/es/7019/",
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. Rules are a short parameter list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        own_host, slash, own_path = name.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[int]:
    """Distinct buckets of the 3- to 5-character n-grams of ^host$ and ^path$; an empty part is one n-gram."""
    found = set()
    for seed, part in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in (3, 4, 5) if len(part) > 2 else (2,):
            if n <= len(part):
                found.update(xxhash.xxh32_intdigest(part[i : i + n].encode("utf-8", "surrogatepass"), seed) >> (32 - BITS) for i in range(len(part) - n + 1))
    return sorted(found)


def fit(examples: list[tuple[str, str, int]], rounds: int = 400, rate: float = 2.0, shrink: float = 2e-3) -> tuple[np.ndarray, float]:
    """examples: host, path, label (1: block). Weights and intercept of the log-odds of block."""
    y, found = np.array([e[2] for e in examples], float), [grams(host, path) for host, path, _ in examples]
    used = np.unique(np.concatenate([np.array(own, int) for own in found]))  # buckets of other n-grams keep weight 0
    x = np.zeros((len(examples), len(used)))
    for i, own in enumerate(found):
        x[i, np.searchsorted(used, own)] = 1 / np.sqrt(max(1, len(own)))
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ miss / len(y) + shrink * w)
        b -= rate * float(miss.mean())
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, b


def labelled() -> list[tuple[str, str, int]]:
    """host, path, label (1: block) of every name in three shapes, and of hosts without a name."""
    bare = ("example.org/", "example.net/en/", "example.com/de/", "www.example.net/fr/12", "/", "")
    out = [(host, slash + path, 0) for host, slash, path in (x.partition("/") for x in bare)]
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            for j in range(3):
                host, slash, path = SHAPES[(3 * i + j) % len(SHAPES)].format(name).partition("/")
                out.append((host, slash + path, label))
    return out


def judged(pages: DataFrame, examples: list[tuple[str, str, int]] | None = None, rules=RULES, bound: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_probability and verdict, under names that pages does not use."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(examples or labelled()))

    def chances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = shared.value
        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths):
                own = grams(host, path)
                out.append(float(1 / (1 + np.exp(-np.clip(w[own].sum() / np.sqrt(max(1, len(own))) + b, -30, 30)))))
            yield pd.Series(out, dtype="float64")

    host, path, rule, chance, verdict = (free_name(pages, c) for c in ("host", "path", "rule", "block_probability", "verdict"))
    fits, says = rule_of(F.col(host), F.col(path), rules)
    out = pages.withColumns({host: host_of(F.col("url")), path: path_of(F.col("url"))})
    out = out.withColumn(chance, F.pandas_udf(chances, "double")(host, path)).withColumn(rule, fits)
    return out.withColumn(verdict, F.coalesce(says, F.when(F.col(chance) >= bound, "block").otherwise("allow")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_probability")
