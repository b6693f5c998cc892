"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over characters are trained from labelled samples: random strings, made from
digests, and ordinary identifiers, made from every word of the corpus, counted once and weighted by
its count. A run of 20 or more key characters is a secret when the ratio of its likelihoods per step
and in total passes a bound and it has at least 8 different characters; of a run that is none, the
pieces between slashes are judged for themselves. Patterns and models only use SQL functions. Spans
count code points, ends are exclusive. Model spans are listed beside pattern spans, also where both
find the same place.

Work is in proportion to a text's length: places of matches are sums over blocks of matches, and
characters of a run are looked up in an array.

Rows: a null text is empty; an empty text has no span; repeated rows give repeated results; other
columns are ignored; with no words in the corpus the model of identifiers knows nothing, and every
step is as likely as another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # same spans as AKIA[A-Z0-9]+ with the short ones dropped: runs are maximal
HEX = r"[0-9a-f]{24,}"
RUN, PIECE = r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+_-]{20,}"
PER_STEP, IN_ALL, DISTINCT = 0.35, 9.0, 8
SAMPLE_RANDOM = 1500
FLOOR = 1e-3  # least likelihood of a step, so that one step that was never seen decides nothing
BLOCK = 256  # matches whose places are summed up together
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_MATCHES = "array<struct<start:int,end:int,m:string>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, m) of the leftmost matches that do not overlap. The pieces between matches give the places."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("n"), m.alias("m")))
    blocks = lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))
    length = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + F.coalesce(x["n"], F.lit(0)))
    begins = lambda bs: F.aggregate(F.transform(bs, length), F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        own = F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("m"))).cast(_MATCHES)
        return F.when(x["n"].isNull(), state).otherwise(F.struct((start + x["n"]).alias("at"), F.concat(state["out"], own).alias("out")))

    def placed(bs: Column) -> Column:
        one = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_MATCHES).alias("out")), step, lambda s: s["out"])
        return _let(begins(bs), lambda at: F.flatten(F.transform(bs, lambda block, i: one(block, F.get(at, i)))))

    return F.when(text.rlike(pattern), _let(_let(pairs, blocks), placed)).otherwise(F.array().cast(_MATCHES))


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(_SPANS)


def random_samples(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """value: strings without structure in the alphabets that keys use, from digests of numbers."""
    digest = F.unhex(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256))
    text = F.regexp_replace(F.base64(digest), "=", "")
    forms = (text, F.translate(text, "+/", "-_"), F.upper(F.regexp_replace(text, "[+/]", "")), F.lower(F.hex(digest)))
    return spark.range(n).select(F.explode(F.array(*forms)).alias("value"))


def ordinary_samples(docs: DataFrame) -> DataFrame:
    """value, n: every word of the docs in the forms that identifiers give it, weighted by its count."""
    words = docs.select(F.explode(F.regexp_extract_all(text_or_empty("text"), F.lit("[A-Za-z]{2,15}"), F.lit(0))).alias("w"))
    w, counted = F.col("w"), words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    low, up, number = F.lower(w), F.upper(w), F.pmod(F.hash(w), F.lit(9973)).cast("string")
    forms = (
        F.concat(F.lit("_"), w, F.lit("_")), F.concat(low, F.initcap(w)), F.concat(F.lit("-"), low, F.lit("-")), F.concat(F.lit("/"), low, F.lit("/")),
        F.concat(F.lit("_"), up, F.lit("_")), F.concat(w, number, F.lit("-")), F.concat(F.lit("-"), number, F.lit("_"), low),
    )
    return counted.select(F.explode(F.array(*forms)).alias("value"), "n")


def samples(docs: DataFrame) -> DataFrame:
    """value, n, random: the labelled samples of both kinds."""
    drawn = random_samples(docs.sparkSession).select("value", F.lit(1).cast("long").alias("n"), F.lit(True).alias("random"))
    return drawn.union(ordinary_samples(docs).select("value", "n", F.lit(False)))


def train(labelled: DataFrame) -> list[float]:
    """labelled: value, n (weight), random. The log-likelihood ratio of each step, by both characters.

    Counts are aggregated by Spark; what reaches the driver is the alphabet squared, twice.
    """
    size = len(_ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    steps = labelled.where(F.char_length("value") > 1).select("random", "n", F.explode(pairs).alias("step"))
    counted = steps.where(F.col("step").rlike(f"^[{_ALPHABET[:-1]}-]{{2}}$")).groupBy("random", "step").agg(F.sum("n").alias("n")).collect()
    counts = {kind: [[0.0] * size for _ in range(size)] for kind in (True, False)}
    for r in counted:
        counts[r["random"]][_ALPHABET.index(r["step"][0])][_ALPHABET.index(r["step"][1])] = float(r["n"])

    def likelihoods(row: list[float]) -> list[float]:
        total = sum(row)
        return [((x / total if total else 1 / size) + FLOOR) / (1 + size * FLOOR) for x in row]

    both = zip(*(map(likelihoods, counts[kind]) for kind in (True, False)))
    return [math.log(up) - math.log(down) for ups, downs in both for up, down in zip(ups, downs)]


def _is_random(run: Column, ratio: list[float]) -> Column:
    size = len(_ALPHABET)
    steps = F.split(F.lit(",".join(f"{x:.6f}" for x in ratio)), ",").cast("array<double>")
    places = [-1] * 128
    for i, c in enumerate(_ALPHABET):
        places[ord(c)] = i
    place = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")

    def judged(codes: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda s, i: s + F.get(steps, F.get(codes, i - 1) * size + F.get(codes, i)))
        return (F.size(F.array_distinct(codes)) >= DISTINCT) & (total >= F.greatest(F.lit(IN_ALL), PER_STEP * (F.size(codes) - 1)))

    return _let(F.transform(F.split(run, ""), lambda c: F.get(place, F.ascii(c))), judged)


def _model_matches(text: Column, ratio: list[float]) -> Column:
    """Runs that the models call random, and random pieces between slashes of runs that they do not."""

    def judged(run: Column) -> Column:
        moved = lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["m"].alias("m"))
        pieces = F.transform(F.filter(_matches(run["m"], PIECE), lambda x: _is_random(x["m"], ratio)), moved)
        some = F.when(F.contains(run["m"], F.lit("/")), pieces).otherwise(F.array().cast(_MATCHES))
        return F.when(_is_random(run["m"], ratio), F.array(run).cast(_MATCHES)).otherwise(some)

    return F.flatten(F.transform(_matches(text, RUN), judged))


def with_spans(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """docs with base_spans and secret_spans: arrays of (start, kind, end), kind an index into KINDS."""
    text = text_or_empty("text")
    assign = F.filter(_matches(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(_spans(assign, 0), _spans(_matches(text, ACCESS), 1), _spans(_matches(text, HEX), 2)))
    found = _spans(_model_matches(text, ratio), 3)
    return docs.withColumn("base_spans", base).withColumn("secret_spans", F.array_sort(F.concat("base_spans", found)))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_spans(docs, train(samples(docs)))
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k))  # noqa: E731  a second parameter would be the place
    counts = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_listed("base_spans").cast("binary"), 256).alias("base_sha256"), _listed("secret_spans").alias("spans"))
