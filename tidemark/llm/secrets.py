"""Secret scans: fixed formats, and strings that look random to two character Markov models.

One model is trained on random strings, the other on ordinary identifiers: the pair counts of all words of all documents,
alone, joined and numbered. A token is added when its log-likelihood ratio per character passes a threshold that is set
on identifiers of words that the counts leave out. Training, scoring and search are SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table
from .spans import add_matches, digest, joined, labelled, untouched

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters of a token that the models judge, at least.
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: The models' alphabet: case does not count, all other characters are one symbol (index 0).
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SIZE = len(ALPHABET) + 1
#: Random strings to judge and to learn from, and the share of ordinary identifiers that may be called random.
JUDGED, RANDOMS, MISTAKES = 5000, 4000, 1e-4
#: Words that identifiers join others with.
FIXED = ("user", "name", "config", "value", "index", "total", "data", "file")


@dataclass(frozen=True)
class MarkovPair:
    """ratio: log P(next | char) under the random model less that under the ordinary one, row by row; threshold: per character."""

    ratio: tuple[float, ...]
    threshold: float

    def per_character(self, token: Column) -> Column:
        # One literal: the text of the numbers is cast when the plan is made.
        ratio = F.split(F.lit(",".join(f"{x:.6g}" for x in self.ratio)), ",").cast("array<double>")
        codes = _codes(token)
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(ratio, a * SIZE + b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.lit(1), F.size(codes) - 1)


def _codes(token: Column) -> Column:
    """The index of each character: its place in ALPHABET, or 0."""
    chars = F.filter(F.split(F.lower(token), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def _add(counts: list[float], text: str, n: float) -> None:
    codes = [ALPHABET.find(c) + 1 for c in text]
    for a, b in zip(codes, codes[1:], strict=False):
        counts[a * SIZE + b] += n


def random_strings(spark: SparkSession, first: int, n: int) -> DataFrame:
    """(token): digests in three spellings."""
    raw = F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))
    spelled = F.when(F.col("id") % 3 == 0, F.lower(F.hex(raw))).when(F.col("id") % 3 == 1, F.base64(raw)).otherwise(F.translate(F.base64(raw), "+/=", "-_"))
    return spark.range(first, first + n).select(F.substring(spelled, 1, 40).alias("token"))


def words(docs: DataFrame) -> DataFrame:
    """(w, n): how often each word of four letters or more comes up in all texts, with lower case."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def _ordinary_counts(known: DataFrame) -> list[float]:
    """Pair counts of each word alone, joined to a fixed one by a mark, and numbered, from counts by pair and by first and last letter (bounded by SIZE * SIZE rows)."""
    counts = [1.0] * SIZE * SIZE
    codes = _codes(F.col("w"))
    n = F.size(codes) - 1
    pairs = known.select("n", F.explode(F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * SIZE + b)).alias("p"))
    for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect():
        counts[r.p] += 4.0 * r.n
    for r in known.groupBy(F.substring("w", 1, 1).alias("a"), F.substring("w", -1, 1).alias("b")).agg(F.sum("n").alias("n")).collect():
        for x in FIXED:
            share = r.n / len(FIXED)
            _add(counts, x, 2 * share)
            for edge in (f"{x[-1]}_{r.a}", f"{r.b}-{x[0]}", f"{x[-1]}-1"):
                _add(counts, edge, share)
        for a in "0123456789":
            _add(counts, r.b + a, r.n / 10)
            for b in "0123456789":
                _add(counts, a + b, r.n / 50)
    total = sum(counts)
    _add(counts, "--", 0.01 * total)  # rulers
    return counts


def train(docs: DataFrame) -> MarkovPair:
    """Count which character follows which, in all documents' words and in random strings; SIZE * SIZE counts a model reach the driver, and one quantile."""
    spark = docs.sparkSession
    every = stage(words(docs), "words")
    tenth = F.pmod(F.xxhash64("w"), F.lit(10))  # the first sets the threshold, the second is for evaluate()
    random = [1.0] * SIZE * SIZE
    for r in random_strings(spark, 0, RANDOMS).collect():
        _add(random, r.token.lower(), 1)
    logs = {}
    for kind, n in ((True, random), (False, _ordinary_counts(every.filter(tenth > 1)))):
        sums = [sum(n[a * SIZE : (a + 1) * SIZE]) for a in range(SIZE)]
        logs[kind] = [math.log(x / sums[k // SIZE]) for k, x in enumerate(n)]
    model = MarkovPair(tuple(a - b for a, b in zip(logs[True], logs[False], strict=True)), 0.0)
    out = MarkovPair(model.ratio, max(0.0, calibration(every.filter(tenth == 0)).agg(F.percentile_approx(model.per_character(F.col("token")), 1 - MISTAKES, 100_000)).first()[0] or 0.0))
    discard(every)
    return out


def calibration(every: DataFrame) -> DataFrame:
    """(token) of LEAST characters or more, as they are judged (shorter ones scatter more): identifiers of all the words given."""
    pick, other = (F.get(F.array(*[F.lit(x) for x in FIXED]), F.pmod(F.xxhash64("w", F.lit(k)), F.lit(len(FIXED))).cast("int")) for k in (1, 2))
    number = F.pmod(F.xxhash64("w"), F.lit(3000)).cast("string")
    spelled = F.array("w", F.concat_ws("_", pick, "w"), F.concat_ws("-", "w", pick, number), F.concat_ws("_", pick, "w", other), F.concat_ws("_", other, "w", pick, number))
    return every.select(F.explode(spelled).alias("token")).filter(F.length("token") >= LEAST)


def evaluate(docs: DataFrame, model: MarkovPair) -> dict[str, float]:
    """The share of random strings not learnt from (of 16, 20 and 24 characters, and of 16 letters only) that pass the threshold, and that of held-out identifiers which do."""
    above = lambda t: model.per_character(t) > model.threshold
    tokens = random_strings(docs.sparkSession, 10**9, JUDGED)
    letters = F.substring(F.regexp_replace("token", "[^A-Za-z]", ""), 1, 16)
    shares = [F.avg(above(F.substring("token", 1, n)).cast("int")).alias(f"random_{n}") for n in (16, 20, 24)]
    rates = tokens.agg(*shares, F.avg(F.when(F.length(letters) == 16, above(letters).cast("int"))).alias("letters")).first().asDict()
    # Words that neither the counts nor the threshold have seen.
    false = calibration(words(docs).filter(F.pmod(F.xxhash64("w"), F.lit(10)) == 1)).agg(F.avg(above(F.col("token")).cast("int"))).first()[0]
    return rates | {"identifiers": false}


def find_secrets(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """docs with _assign, _access, _hex and _random: arrays of (start, end, text, group) spans in code points.

    _random are tokens over the model's threshold, of whatever characters, that touch no other span. A null text counts
    as empty; no rows give no rows; columns stay as they are, but for those that begin with an underscore, which are left
    out.
    """
    was = [c for c in docs.columns if not c.startswith("_")]
    out = docs.select(*[docs[f"`{c}`"] for c in was]).withColumn("_text", F.coalesce("text", F.lit("")))
    lower = F.lower("_text")
    word = lower.contains("password") | lower.contains("passwd") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    out = add_matches(out, "_text", {"_assign": (ASSIGN, word), "_access": (ACCESS, F.col("_text").contains("AKIA")), "_hex": (HEX, F.lit(True)), "_token": (TOKEN, F.lit(True))}, {"_assign": 1})
    out = out.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["group"]) >= 6))
    base = F.concat("_assign", "_access", "_hex")
    mixed = F.filter("_token", lambda x: model.per_character(x["text"]) > model.threshold)
    out = out.withColumn("_base", F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).withColumn("_token", mixed)
    out = out.withColumn("_random", untouched(F.col("_token"), F.col("_base")))
    return out.select(*[f"`{c}`" for c in was], "_assign", "_access", "_hex", "_random")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(docs))

    def by_start(*spans: Column) -> Column:
        # start first, then the order of the kinds
        return F.array_sort(F.transform(F.concat(*spans), lambda x: F.struct(x["start"], x["order"], x["kind"], x["end"])))

    base = [labelled(k, i, F.col(f"_{k}")) for i, k in enumerate(KINDS)]
    out = found.withColumn("_base", joined(by_start(*base))).withColumn("_all", joined(by_start(*base, labelled("random", 3, F.col("_random")))))
    return out.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], digest("_base").alias("base_sha256"), F.col("_all").alias("spans"))
