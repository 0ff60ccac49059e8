"""Personal data: fixed formats, and candidates judged by boosted trees.

Generators with high recall propose spans, which may overlap. Gradient-boosted trees judge each by its format and by the
words around it, and a threshold per kind, calibrated on samples not learnt from, selects what is added to the fixed
formats. The trees are trained by Spark ML on labelled spellings set into contexts of the corpus itself, and applied as
SQL expressions. Some spellings are held out altogether: ``evaluate`` reports precision and recall on them.

Repeated groups are possessive throughout: Java matches these in a loop, all others by recursion that a long text breaks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import add_matches, digest, joined, labelled, untouched

KINDS = ("email", "ip", "card", "phone")
#: A match starts where a run of its characters starts, or where the match before it ended: anything else would be tried in vain.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL = _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:\x20[0-9]|-[0-9]|[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: The generators: kind of the span, pattern.
GENERATORS = (
    ("email", _LOCAL + r"\x20?(?:\(at\)|\[at\]|@|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]++)++"),
    ("phone", r"\(?[0-9][0-9\x20().-]{5,}[0-9]"),
    ("ip", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+"),
    ("card", r"(?<![0-9])[0-9](?:[0-9]|[\x20./_-][0-9]|[\x20./_-][\x20./_-][0-9])++"),
)
#: Labelled samples, the share of true ones that a threshold must give among those it selects, code points of context before, documents that give contexts at most.
SAMPLES, PRECISION, BEFORE, CONTEXTS = 9000, 0.98, 24, 400
FEATURES = ("generator", "digits", "size", "separators", "groups", "at", "colons", "letters", "bracket", "hint", "counter", "touches", "date", "colon", "dots")


def _features(generator: Column, text: Column, before: Column, after: Column) -> Column:
    def flag(x: Column) -> Column:
        return x.cast("double")

    context = F.lower(before)
    return F.struct(
        generator.cast("double").alias("generator"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("digits"),
        F.length(text).cast("double").alias("size"),
        F.length(F.regexp_replace(text, r"[^\x20().-]", "")).cast("double").alias("separators"),
        F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))).cast("double").alias("groups"),
        flag(text.rlike(r"\(at\)|\[at\]|@")).alias("at"),
        F.length(F.regexp_replace(text, "[^:]", "")).cast("double").alias("colons"),
        flag(text.rlike("[A-Fa-f]")).alias("letters"),
        flag(text.startswith("(")).alias("bracket"),
        flag(context.rlike(r"tel|phone|call|fax|mobile|contact|mail|write|reach|host|address")).alias("hint"),
        flag(context.rlike(r"order|invoice|no\.|page|version|isbn|total|price|date|item|ref|time")).alias("counter"),
        flag(after.rlike("^[A-Za-z0-9_]") | before.rlike("[A-Za-z0-9_.+-]$")).alias("touches"),
        flag(text.rlike(r"^(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](\d{2}|\d{4}))$")).alias("date"),
        flag(before.rlike(r"[:=]\x20?$")).alias("colon"),
        F.length(F.regexp_replace(text, "[^.]", "")).cast("double").alias("dots"),
    )


def contexts(docs: DataFrame) -> list[str]:
    """Stretches of BEFORE code points, one from each of at most CONTEXTS documents (picked by a hash of doc_id), cut between words."""
    long = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 3 * BEFORE))
    some = long.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CONTEXTS)
    at = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.length("text") - 2 * BEFORE)
    piece = F.regexp_replace(F.substring("text", at.cast("int"), F.lit(BEFORE)), r"\S*$|[\n\r\x00]", "")
    rows = long.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(piece).alias("x")).orderBy("doc_id").limit(CONTEXTS).collect()
    return [r.x for r in rows] or [" "]


def samples(spark: SparkSession, around: list[str]) -> DataFrame:
    """(id, label, held: whether the spelling is held out, the features): SAMPLES spellings, personal or not, in contexts of the corpus, with cues or without."""

    def draw(k: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))

    def number(k: int, size: int) -> Column:
        return F.lpad(draw(k, 10**size).cast("string"), size, "0")

    def one_of(k: int, *words: str) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), draw(k, len(words)).cast("int"))

    user = F.concat(one_of(1, "anna", "j.smith", "info", "sales", "max", "lee_k"), draw(2, 90).cast("string"))
    host = F.concat(one_of(3, "mail", "example", "uni", "corp"), draw(4, 30).cast("string"))
    hexes = [F.lower(F.hex(draw(20 + k, 65536))) for k in range(6)]
    first = F.concat(F.lit("4"), number(5, 7), number(6, 7))
    card = F.concat(first, (F.pmod(10 - _sum(F.concat(first, F.lit("0"))) % 10, F.lit(10))).cast("string"))
    by_four = lambda sep: F.concat_ws(sep, *[F.substring(card, 1 + 4 * k, 4) for k in range(4)])
    # generator, label, held out, text
    spelled = [
        (1, 1, 0, F.concat(F.lit("("), number(5, 3), F.lit(") "), number(6, 3), F.lit("-"), number(7, 4))),
        (1, 1, 0, F.concat_ws("-", number(5, 3), number(6, 3), number(7, 4))),
        (1, 1, 0, F.concat_ws(" ", F.concat(F.lit("0"), number(5, 2)), number(6, 4), number(7, 4))),
        (1, 1, 1, F.concat_ws(".", number(5, 3), number(6, 3), number(7, 4))),
        (1, 1, 1, F.concat_ws(" ", F.concat(F.lit("0"), number(5, 1)), number(6, 2), number(7, 2), number(8, 2), number(15, 2))),
        (0, 1, 0, F.concat(user, F.lit(" (at) "), host, F.lit(" (dot) com"))),
        (0, 1, 0, F.concat(user, F.lit("[at]"), host, F.lit(".org"))),
        (0, 1, 0, F.concat(user, F.lit(" at "), host, F.lit(" dot com"))),
        (0, 1, 1, F.concat(user, F.lit("(at)"), host, F.lit("[dot]net"))),
        (0, 1, 1, F.concat(user, F.lit(" [at] "), host, F.lit(" dot co"))),
        (2, 1, 0, F.concat_ws(":", *hexes)),
        (2, 1, 0, F.concat_ws(":", *hexes[:3], F.lit(""), *hexes[3:5])),
        (2, 1, 1, F.concat(F.lit("fe80::"), F.concat_ws(":", *hexes[:4]))),
        (3, 1, 0, by_four(".")),
        (3, 1, 0, by_four("  ")),
        (3, 1, 1, by_four("/")),
        (3, 1, 1, by_four("_")),
        (1, 0, 0, F.concat_ws("-", F.concat(F.lit("20"), number(5, 2)), F.lpad((draw(6, 12) + 1).cast("string"), 2, "0"), F.lpad((draw(7, 28) + 1).cast("string"), 2, "0"))),
        (1, 0, 0, F.concat_ws(".", number(5, 2), number(6, 2), F.concat(F.lit("19"), number(7, 2)))),
        (1, 0, 0, F.concat_ws(".", number(5, 5), number(6, 5))),
        (1, 0, 0, number(5, 9)),
        (1, 0, 0, F.concat_ws(" ", number(5, 4), number(6, 4), number(7, 4), number(8, 3))),
        (1, 0, 0, F.concat_ws(" ", number(5, 8), F.concat(number(6, 8), number(7, 6)))),
        (1, 0, 1, F.concat_ws("-", F.lpad((draw(6, 12) + 1).cast("string"), 2, "0"), F.lpad((draw(7, 28) + 1).cast("string"), 2, "0"), F.concat(F.lit("20"), number(5, 2)))),
        (1, 0, 1, number(5, 8)),
        (2, 0, 0, F.concat_ws(":", number(5, 2), number(6, 2), number(7, 2), number(8, 2))),
        (2, 0, 1, F.concat_ws(":", number(5, 1), number(6, 2), number(7, 2), number(8, 2), number(15, 1))),
        (0, 0, 0, F.concat(one_of(1, "look", "meet", "stay"), F.lit(" at "), one_of(3, "home", "noon", "once"), F.lit("."), one_of(4, "then", "the", "now"))),
        (0, 0, 1, F.concat(one_of(1, "was", "arrive", "is"), F.lit(" at "), one_of(3, "work", "sea", "least"), F.lit("."), one_of(4, "and", "it", "so"))),
        (3, 0, 0, F.concat_ws(".", *[number(k, 3) for k in (5, 6, 7, 8, 15)])),
        (3, 0, 0, F.concat_ws("-", number(5, 4), number(6, 2), number(7, 2), number(8, 6))),
        (3, 0, 1, F.concat_ws(" ", *[number(k, 3) for k in (5, 6, 7, 8, 15)])),
    ]
    which = F.pmod(F.col("id"), F.lit(len(spelled))).cast("int")
    pick = F.get(F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(y).alias("label"), F.lit(h).alias("held"), t.alias("text")) for g, y, h, t in spelled]), which)
    rows = spark.range(SAMPLES).withColumn("x", pick)
    prose = F.get(F.split(F.lit("\0".join(around)), "\0"), draw(9, len(around)).cast("int"))
    hint = one_of(10, "phone: ", "call me: ", "contact ", "mail ", "host ", "tel. ", "pay with card ")
    counter = one_of(11, "order ", "invoice no. ", "version ", "total ", "date ", "item ")
    cue = F.when(draw(12, 10) < 4, "").when(F.col("x.label") == 1, hint).otherwise(counter)
    after = one_of(13, " and", ".", ",", "", " ")
    # Some personal-looking numbers that the context gives away as something else.
    label = F.when((F.col("x.generator") == 1) & (F.col("x.label") == 1) & (draw(14, 10) < 3), 0).otherwise(F.col("x.label"))
    rows = rows.withColumn("label", label).withColumn("before", F.substring(F.concat(prose, F.when(label != F.col("x.label"), counter).otherwise(cue)), -BEFORE, BEFORE))
    return rows.select("id", "label", "x.held", _features(F.col("x.generator"), F.col("x.text"), F.col("before"), after).alias("f")).select("id", "label", "held", "f.*")


def _tree(lines: list[str]):
    """A tree's function from features to its prediction, from its printed form."""
    line = lines.pop(0).strip()
    if found := re.match(r"Predict: (\S+)", line):
        value = float(found[1])
        return lambda x: F.lit(value)
    found = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    name, edge = FEATURES[int(found[1])], float(found[2])
    low = _tree(lines)
    lines.pop(0)
    high = _tree(lines)
    return lambda x: F.when(x[name] <= edge, low(x)).otherwise(high(x))


@dataclass
class CandidateModel:
    """trees: (weight, function of the features); thresholds: of the probability, by generator."""

    trees: list
    thresholds: list[float]

    def probability(self, x: Column) -> Column:
        total = reduce(lambda a, b: a + b, [tree(x) * weight for weight, tree in self.trees])
        return 1 / (1 + F.exp(-2 * total))


def train(docs: DataFrame) -> CandidateModel:
    """Boost on two thirds of the samples, calibrate on the rest: per generator the lowest threshold of the wanted precision. Held-out spellings are in neither."""
    # Imported here, as they hold memory on every driver that only imports this subpackage.
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = docs.sparkSession
    rows = samples(spark, contexts(docs)).filter("held = 0").repartition(2, "id").sortWithinPartitions("id").cache()
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.3, seed=5).fit(vector.transform(rows.filter("id % 3 != 0")))
    trees = []
    for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
        trees.append((float(weight), _tree(tree.toDebugString.splitlines()[1:])))
    model = CandidateModel(trees, [])
    x = F.struct(*FEATURES)
    seen = rows.filter("id % 3 = 0").select("generator", "label", F.round(model.probability(x), 4).alias("p")).groupBy("generator", "p").agg(F.sum("label").alias("true"), F.count("*").alias("n")).collect()
    rows.unpersist()
    for g in range(len(GENERATORS)):
        best, true, n = 1.1, 0, 0
        for r in sorted((r for r in seen if r.generator == g), key=lambda r: -r.p):
            true, n = true + r.true, n + r.n
            if true >= PRECISION * n and r.p >= 0.5:
                best = r.p - 5e-5
        model.thresholds.append(best)
    return model


def evaluate(docs: DataFrame, model: CandidateModel) -> DataFrame:
    """(kind, precision, recall) per generator on the spellings that training never saw."""
    kinds = F.array(*[F.lit(k) for k, _ in GENERATORS])
    limit = F.get(F.array(*[F.lit(t) for t in model.thresholds]), F.col("generator").cast("int"))
    rows = samples(docs.sparkSession, contexts(docs)).filter("held = 1").select("generator", "label", (model.probability(F.struct(*FEATURES)) >= limit).cast("int").alias("chosen"))
    right = F.sum(F.col("label") * F.col("chosen"))
    return rows.groupBy("generator").agg((right / F.nullif(F.sum("chosen"), F.lit(0))).alias("precision"), (right / F.sum("label")).alias("recall")).select(F.get(kinds, F.col("generator").cast("int")).alias("kind"), "precision", "recall")


def _sum(digits: Column) -> Column:
    """The check sum of a string of digits, every second one from the right but for the last doubled."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    return _sum(digits) % 10 == 0


def find_pii(docs: DataFrame, model: CandidateModel) -> DataFrame:
    """docs with _email, _ip, _card, _phone: spans of the fixed formats, and _added: (order, start, kind, end) of those the model adds.

    Places are code points, end exclusive. An added span overlaps no fixed one; of added ones that overlap, the likelier
    stays (the earlier generator on ties). A null text counts as empty; no rows give no rows; columns stay as
    they are, but for those that begin with an underscore, which are left out.
    """
    was = [c for c in docs.columns if not c.startswith("_")]
    out = docs.select(*[docs[f"`{c}`"] for c in was]).withColumn("_text", F.coalesce("text", F.lit("")))
    text = F.col("_text")
    out = out.withColumn("_digits", text.rlike("[0-9]"))
    at = text.contains("@")
    patterns = {"_email": (EMAIL, at), "_ip": (IP, F.col("_digits") & text.contains(".")), "_card": (CARD, F.col("_digits")), "_phone": (PHONE, text.contains("+"))}
    spelled = text.rlike(r"\(at\)|\[at\]|\x20at\x20")
    gates = (at | spelled, F.col("_digits"), text.contains(":"), F.col("_digits"))
    patterns |= {f"_c{g}": (pattern, gate) for g, ((_, pattern), gate) in enumerate(zip(GENERATORS, gates, strict=True))}
    out = add_matches(out, "_text", patterns, before=BEFORE, around=tuple(f"_c{g}" for g in range(len(GENERATORS))))
    digits = lambda x: F.regexp_replace(x["text"], "[^0-9]", "")
    out = out.withColumns(
        {
            "_ip": F.filter("_ip", lambda x: x["text"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
            "_card": F.filter("_card", lambda x: F.when(F.length(digits(x)).between(13, 19), _luhn(digits(x))).otherwise(False)),
            "_phone": F.filter("_phone", lambda x: F.length(digits(x)).between(9, 15)),
        }
    )
    out = out.withColumn("_base", F.transform(F.concat("_email", "_ip", "_card", "_phone"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def free(g: int) -> Column:
        # A phone number has 7 to 15 digits, a card 13 to 19 with a check sum.
        rules = {"phone": lambda x: F.length(digits(x)).between(7, 15), "card": lambda x: F.when(F.length(digits(x)).between(13, 19), _luhn(digits(x))).otherwise(False)}
        fits = rules.get(GENERATORS[g][0], lambda x: F.lit(True))
        return untouched(F.filter(f"_c{g}", fits), F.col("_base"))

    out = out.withColumns({f"_c{g}": free(g) for g in range(len(GENERATORS))})

    def judged(g: int) -> Column:
        return F.transform(f"_c{g}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _features(F.lit(g), x["text"], x["before"], x["after"]).alias("f")))

    out = out.withColumns({f"_c{g}": judged(g) for g in range(len(GENERATORS))})

    def scored(g: int) -> Column:
        spans = F.transform(f"_c{g}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(g).alias("g"), model.probability(x["f"]).alias("p")))
        return F.filter(spans, lambda x: x["p"] >= model.thresholds[g])

    out = out.withColumn("_judged", F.concat(*[scored(g) for g in range(len(GENERATORS))]))
    better = lambda y, x: (y["g"] != x["g"]) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & (y["g"] < x["g"])))
    out = out.withColumn("_judged", untouched(F.col("_judged"), F.col("_judged"), better))
    kind = lambda x: F.get(F.array(*[F.lit(k) for k, _ in GENERATORS]), x["g"])
    order = lambda x: F.get(F.array(*[F.lit(KINDS.index(k)) for k, _ in GENERATORS]), x["g"])
    added = F.transform("_judged", lambda x: F.struct(order(x).alias("order"), x["start"].alias("start"), kind(x).alias("kind"), x["end"].alias("end")))
    return out.select(*[f"`{c}`" for c in was], *[f"_{k}" for k in KINDS], added.alias("_added"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, train(docs))
    base = [labelled(k, i, F.col(f"_{k}")) for i, k in enumerate(KINDS)]
    out = found.withColumn("_base", joined(F.array_sort(F.concat(*base)))).withColumn("_all", joined(F.array_sort(F.concat(*base, F.col("_added")))))
    return out.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], digest("_base").alias("base_sha256"), F.col("_all").alias("spans"))
