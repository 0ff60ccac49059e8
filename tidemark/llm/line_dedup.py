"""Line dedup: content-defined chunks of lines, removed where the same chunk came up before.

Hashes of the lines pick the boundaries, in SETS boundary sets of two classes each: a line bounds the class that its bit
of the set names, and a chunk runs from one bounding line of a class to the next, both included. So a chunk has two lines
at least, hangs on no line outside of it and moves with its lines. A passage of k lines that comes up again is missed
whole only if no two of its lines agree in any bit (k = 2: one in 2 ** SETS; k > 2: never), and loses its first or last
line only if that line agrees with no other of the passage in any bit. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, stage, table

#: Boundary sets: more find more of the passages of two lines, and make more chunks.
SETS = 4
#: What dedup_lines adds to each row.
COUNTS = ("_n_lines", "_n_chunks", "_cut_chunks", "_cut_lines")


def line_hashes(text: str) -> Column:
    """60 bits of the MD5 of each line."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long"))


def add_chunks(docs: DataFrame) -> DataFrame:
    """docs with _chunks, from their _hashes: an array of start << 31 | end, places of the two bounding lines of each chunk."""

    def neighbours(k: int, bit: int) -> Column:
        def of_class(x: Column, i: Column) -> Column:
            return F.when(F.shiftright(x, k).bitwiseAND(F.lit(1)) == bit, i.cast("long"))

        at = F.filter(F.transform("_hashes", of_class), lambda i: i.isNotNull())
        n = F.greatest(F.size(at) - 1, F.lit(0))
        return F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: F.shiftleft(a, 31) + b)

    each = {f"_n{k}{bit}": neighbours(k, bit) for k in range(SETS) for bit in (0, 1)}
    return docs.withColumns(each).withColumn("_chunks", F.array_distinct(F.concat(*each))).drop(*each)


def _start(chunk: Column) -> Column:
    return F.shiftright(chunk, 31).cast("int")


def _end(chunk: Column) -> Column:
    return (chunk - F.shiftleft(F.shiftright(chunk, 31), 31)).cast("int")


def _exploded(df: DataFrame, array: str, *columns: str) -> DataFrame:
    """A row per element, as _x. explode() would make Spark filter on the array's size before it is built, with every step before copied into the filter."""
    return df.select(*columns, F.explode_outer(array).alias("_x")).filter("_x IS NOT NULL")


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the documents' _id, _id_of, _n_chunks and _found: their repeated chunks (start, end, again: whether it came up before); the hashes of the lines in them).

    docs: doc_id, _of, text, none null. Only chunks whose bounding lines both repeat are hashed and compared.
    """
    lined = add_chunks(docs.select("doc_id", "_of", line_hashes("text").alias("_hashes")))
    lined = stage(lined, "lined")
    lines = lined.select("doc_id", "_of", F.posexplode("_hashes").alias("_at", "_line"))
    twice = stage(lines.groupBy("_line").agg(F.count("*").alias("_w")).filter("_w > 1"), "twice")
    total = lined.agg(F.sum(F.size("_hashes"))).first()[0] or 0
    known = lookup_join(lines, twice, ["_line"], "_w", total, F.xxhash64("doc_id", "_at")).filter("_w IS NOT NULL")
    known = known.groupBy("doc_id", "_of").agg(F.array_sort(F.collect_set("_at")).alias("_rep"))
    n = F.greatest(F.size("_rep") - 1, F.lit(0))
    gaps = F.zip_with("_rep", F.concat(F.array(F.lit(-1)), F.slice("_rep", F.lit(1), n)), lambda at, was: at - was - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    some = lined.join(known.filter(F.size("_rep") > 1), ["doc_id", "_of"]).withColumn("_flag", flags)
    some = some.withColumn("_chunks", F.filter("_chunks", lambda x: F.coalesce(F.get("_flag", _start(x)) & F.get("_flag", _end(x)), F.lit(False))))
    own = F.slice("_hashes", _start(F.col("_x")) + 1, _end(F.col("_x")) - _start(F.col("_x")) + 1)
    places = _exploded(some, "_chunks", "doc_id", "_of", "_hashes").select("doc_id", "_of", "_x", own.alias("_own"))
    places = stage(places.select("doc_id", "_of", "_x", "_own", F.xxhash64("_own").alias("h1"), F.xxhash64(F.lit(7), "_own").alias("h2")), "places")
    first = F.min(F.struct("doc_id", "_of", "_x")).alias("_keep")
    groups = places.groupBy("h1", "h2").agg(F.count("*").alias("_w"), first, F.min("_own").alias("_a"), F.max("_own").alias("_b"))
    repeats = stage(groups.filter("_w > 1 AND _a = _b").drop("_a", "_b"), "repeats")
    found = lookup_join(places, repeats, ["h1", "h2"], "_w", places.count(), F.xxhash64("doc_id", "_x")).filter(F.col("_keep").isNotNull())
    again = F.struct("doc_id", "_of", "_x") != F.col("_keep")
    found = stage(found.select("doc_id", "_of", "_own", F.struct(_start(F.col("_x")).alias("start"), _end(F.col("_x")).alias("end"), again.alias("again")).alias("_chunk")), "found")
    hashes = found.select(F.explode("_own").alias("_line")).distinct()
    of_doc = found.groupBy("doc_id", "_of").agg(F.collect_set("_chunk").alias("_found"))
    counts = lined.select(F.col("doc_id").alias("_id"), F.col("_of").alias("_id_of"), F.size("_chunks").alias("_n_chunks")).dropDuplicates(["_id", "_id_of"])
    of_doc = counts.join(of_doc, (F.col("_id") == F.col("doc_id")) & (F.col("_id_of") == F.col("_of")), "left").select("_id", "_id_of", "_n_chunks", "_found")
    return of_doc, hashes


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines of every repeated chunk cut from ``text``, and the counts _n_lines, _n_chunks, _cut_chunks, _cut_lines.

    Of equal chunks (the same bytes) the one in the smallest doc_id, then first in it, stays whole as far as no other
    repeat covers its lines; a line that is cut always comes up earlier (in doc_id, then place). Lines that repeat alone
    stay. Other columns keep their order, names and values, whatever they are; those named like the counts are replaced.
    A null text stays null with counts 0; an empty one is one empty line. Rows without doc_id stay whole and count for
    nobody. Rows that repeat a doc_id and its text are one document. No rows give no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", *COUNTS)]
    rest = F.struct(F.lit(0).alias("_none"), *[docs[f"`{c}`"] for c in others]).alias("_rest")
    keyed = docs.select("doc_id", "text", rest).withColumn("_of", F.xxhash64("text"))
    of_doc, hashes = repeated_chunks(keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "_of", "text"))
    whole = keyed.filter("doc_id IS NOT NULL").join(of_doc, (F.col("doc_id") == F.col("_id")) & (F.col("_of") == F.col("_id_of")), "left").drop("_id", "_id_of", "_of")
    whole = stage(whole.unionByName(keyed.filter("doc_id IS NULL").drop("_of"), allowMissingColumns=True), "whole")
    cut = F.filter(F.coalesce("_found", F.array()), lambda x: x["again"])
    differ = _unequal(whole, hashes)
    if differ is not None:  # lines of one hash and other bytes: chunks with such lines stay
        whole = whole.withColumn("_row", F.monotonically_increasing_id())
        bad = whole.select("_row", F.posexplode(line_hashes("text")).alias("_at", "_line")).join(differ, "_line", "left_semi").groupBy(F.col("_row").alias("_bad_row")).agg(F.collect_set("_at").alias("_bad"))
        whole = whole.join(bad, F.col("_row") == F.col("_bad_row"), "left").drop("_row", "_bad_row")
        cut = F.filter(cut, lambda x: ~F.exists(F.coalesce("_bad", F.array()), lambda i: (i >= x["start"]) & (i <= x["end"])))
    out = whole.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_cut", cut)
    out = out.withColumn("_gone", F.array_distinct(F.flatten(F.transform("_cut", lambda x: F.sequence(x["start"], x["end"])))))
    out = out.withColumn("_left", F.array_except(F.transform(F.coalesce("_lines", F.array()), lambda x, i: i), "_gone"))
    kept = F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    counts = [n_lines, F.coalesce("_n_chunks", F.lit(0)), F.size("_cut"), F.size("_gone")]
    named = {"doc_id": F.col("doc_id"), "text": F.when(F.size("_cut") > 0, kept).otherwise(F.col("text")).alias("text")} | {c: F.col("_rest").getField(c).alias(c) for c in others}
    return out.select(*[named[c] for c in docs.columns if c in named], *[x.cast("long").alias(c) for x, c in zip(counts, COUNTS, strict=True)])


def _unequal(whole: DataFrame, hashes: DataFrame) -> DataFrame | None:
    """The hashes of lines in repeated chunks behind which more than one text stands, or None: the least and the greatest line of each hash are compared by their bytes."""
    lines = whole.filter("_found IS NOT NULL").select(F.explode(F.arrays_zip(F.split("text", "\n", -1).alias("text"), line_hashes("text").alias("hash"))).alias("x"))
    texts = lines.groupBy(F.col("x.hash").alias("_line")).agg(F.min("x.text").alias("a"), F.max("x.text").alias("b")).filter("a != b")
    differ = stage(texts.select("_line").join(hashes, "_line", "left_semi"), "differ")
    return differ if differ.take(1) else None


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_chunks").alias("n_chunks"), F.col("_cut_chunks").alias("cut_chunks"), F.col("_cut_lines").alias("cut_lines"), F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 15))::BIGINT AS v FROM l),
b AS (SELECT h.doc_id, h.i, k, (h.v >> k) & 1 AS bit FROM h, range(4) AS s(k)),
p AS (SELECT doc_id, i AS s, lead(i) OVER (PARTITION BY doc_id, k, bit ORDER BY i) AS e FROM b),
c AS (SELECT DISTINCT doc_id, s, e FROM p WHERE e IS NOT NULL),
t AS (SELECT c.*, array_to_string(d.ls[c.s:c.e], chr(10)) AS txt, c.e - c.s + 1 AS n FROM c JOIN d USING (doc_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY txt, n ORDER BY doc_id, s) > 1 AS cut FROM t),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM m WHERE cut),
n AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (cut) AS cut_chunks FROM m GROUP BY doc_id),
o AS (SELECT l.doc_id, count(g.i) AS cut_lines, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS left_text FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, len(d.ls) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(cut_chunks, 0) AS cut_chunks, coalesce(cut_lines, 0) AS cut_lines,
       length(coalesce(left_text, '')) AS n_chars, sha256(coalesce(left_text, '')) AS text_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""
