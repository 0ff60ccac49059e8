"""Source divergence audit: how far the term frequencies of each source are from those of its language's other sources.

Each term of a language becomes one wide row: higher-order functions pivot its counts into an array by source and smooth
them into frequencies. Rows then emit the contributions of all pairs of sources, and the map side of an aggregate adds
them up, so that a task ships one row for each pair and no more, however many terms it holds. The pairs come from two
explodes of the array, and their arithmetic runs in generated code: as a lambda, which Spark interprets, it takes seven
times as long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, lookup_join, stage, table

#: What lies between terms: controls, ASCII marks and digits. A term is a run of ASCII letters and of characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term occurs in, at least; ranks of terms that a group returns; frequencies are in parts of SCALE.
LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n: occurrences, d: documents with the term) of docs (text, lang, source; null counts as '')."""
    # lower() also changes letters beyond ASCII, but is much faster where there are none.
    text = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    some = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.split(text, BETWEEN).alias("terms"))
    # An occurrence of a term adds to n, its entry among the distinct terms to d: both leave the task summed by term.
    every = F.array(F.struct(F.col("terms").alias("terms"), F.lit(0).alias("d")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(1).alias("d")))
    rows = some.select("lang", "source", F.explode(every).alias("x")).select("lang", "source", "x.d", F.explode("x.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("d")).alias("n"), F.sum("d").alias("d")).filter("term != ''")


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, by: map of source to occurrences, n) of the terms in at least LEAST_DOCS documents of their language."""
    out = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"), F.sum("n").alias("n"))
    return out.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", F.map_from_entries("by").alias("by"), "n")


def languages(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each lang: sources (all that occur, in order of their bytes), totals (kept occurrences by source), total, v (kept terms)."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = terms.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    found = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    none = F.lit(0).cast("long")
    return found.join(whole, "lang", "left").select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("totals"), F.coalesce("total", none).alias("total"), F.coalesce("v", none).alias("v"))


def _share(count: str, total: str) -> str:
    """SQL for 1 + floor(SCALE * (count + 1) / (total + v)), three digits at a time: no product leaves 64 bits below 9e15 occurrences."""
    of = f"({total} + v)"
    first, second = f"(({count} + 1) * 1000)", f"(({count} + 1) * 1000 % {of} * 1000)"
    return f"(1 + {first} div {of} * 1000000 + {second} div {of} * 1000 + {second} % {of} * 1000 div {of})"


def _excess(p: str, q: str) -> str:
    """SQL for floor((p - q)^2 / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def wide_terms(terms: DataFrame, langs: DataFrame, total: int) -> DataFrame:
    """(lang, term, sources, counts and p: arrays by source, q: the language's p) of each kept term; ``total`` counts them."""
    rows = lookup_join(terms, langs, ["lang"], "v", total, F.col("term"))
    rows = rows.withColumn("counts", F.expr("transform(sources, s -> coalesce(try_element_at(by, s), 0L))"))
    return rows.select("lang", "term", "sources", "counts", F.expr(f"transform(arrays_zip(counts, totals), x -> {_share('x.counts', 'x.totals')})").alias("p"), F.expr(_share("n", "total")).alias("q"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def pair_values(wide: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum over its kept terms, 0 without any.

    A term's array meets itself source by source; what a task ships are sums, one row for each pair of a language.
    """
    one = wide.select("lang", "p", F.posexplode("p").alias("a", "own"))
    each = one.select("lang", "a", "own", F.posexplode("p").alias("b", "other")).filter("a != b")
    sums = each.groupBy("lang", "a", "b").agg(F.sum(F.expr(_excess("own", "other"))).alias("f"))
    pairs = langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    pairs = pairs.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a != b")
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))


def term_values(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each term that a source uses, and uses more than its language."""
    each = wide.select("lang", F.col("term").alias("item"), "q", F.explode(F.arrays_zip("sources", "counts", "p")).alias("x"))
    return each.filter("x.counts > 0 AND x.p > q").select("lang", "x.sources", "item", F.expr(_excess("x.p", "q"))).toDF("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) group of docs; other columns are not read.

    Part ``pair`` ranks the other sources of the language by divergence, part ``term`` the group's own terms, up to rank
    ``top``. Null text, lang and source count as ''. Repeated rows count each; equal values are ranked by the bytes of the
    item. A group without terms has its pairs only, a language of one source its terms only; no rows give no rows.
    """
    terms = stage(kept_terms(term_counts(docs)), "terms")
    langs = stage(languages(docs, terms), "langs")
    wide = wide_terms(terms, langs, terms.count())
    out = stage(_ranked(pair_values(wide, langs), "pair").union(_ranked(term_values(wide), "term").filter(F.col("rank") <= top)), "divergence")
    discard(terms)
    discard(langs)
    return out


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(gn.total, 0) + v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c.n) + 1) // (any_value(ln.total) + any_value(v.v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""
