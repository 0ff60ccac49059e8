"""Exact dedup against a persistent digest index: bucketed and sorted by digest, probed by a sort-merge anti-join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lookup_join, stage, table

#: Rows of a bucket at most, by expectation.
ROWS_A_BUCKET = 2_000_000
#: The white space that does not count: space, \\t, \\n, \\v, \\f, \\r.
SPACES = " \t\n\x0b\x0c\r"


def _best(chars: str, id_: str) -> Column:
    """Of rows the one with the most code points, then the least id; null ids come last."""
    return F.min(F.struct((-F.col(chars)).alias("less"), F.col(id_).isNull().alias("none"), F.col(id_).alias("id")))


def normal_text(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """A table (digest, keep_id, keep_chars) in buckets by digest, sorted, which outlives the session at ``path``.

    Opening a path again finds the rows of earlier loads. Without a path the table lies in the warehouse. A digest can have
    several rows, one for each time that a better one came; the best counts. ``expected`` rows set the number of buckets
    of a new table: as many as keep a bucket under ROWS_A_BUCKET, 64 at least.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, expected: int = 0, buckets: int | None = None):
        self.spark, self.name = spark, name
        n, where = buckets or max(64, -(-expected // ROWS_A_BUCKET)), f"LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, keep_chars INT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS {where}")
        self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first().data_type)

    def rows(self) -> DataFrame:
        """The best row of each digest. Buckets hold all rows of a digest, so that nothing is shuffled."""
        return self.spark.table(self.name).groupBy("digest").agg(_best("keep_chars", "keep_id").alias("b")).select("digest", F.col("b.id").alias("keep_id"), (-F.col("b.less")).alias("keep_chars"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks, by a sort-merge anti-join with its buckets: the index is not shuffled; Spark sorts a bucket again once it has several files."""
        return groups.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def beaten(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index has with a worse row: fewer code points, or as many and a larger or null id."""
        old = self.rows().select("digest", F.col("keep_id").alias("old_id"), F.col("keep_chars").alias("old_chars")).hint("merge")
        mine, theirs = (F.struct(-F.col(n), F.col(i).isNull(), F.coalesce(F.col(i), F.lit(0))) for n, i in (("keep_chars", "keep_id"), ("old_chars", "old_id")))
        return groups.join(old, "digest").filter(mine < theirs).select(*groups.columns)

    def append(self, groups: DataFrame) -> None:
        new = groups.select("digest", "keep_id", "keep_chars")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def compact(self) -> None:
        """Write the best rows again, one file a bucket: loads add a file each, and files of rows that were beaten."""
        best = stage(self.rows(), "compact")
        best.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name, overwrite=True)
        discard(best)

    def drop(self) -> None:
        """Remove the table; its rows too, if it lies in the warehouse."""
        self.spark.sql(f"DROP TABLE {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the text without white space, n_chars of the text) of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(normal_text(F.col("text")).cast("binary"), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def exact_dedup(docs: DataFrame, index: DigestIndex, better: bool = False) -> DataFrame:
    """Deduplicate a load of documents within itself and against the index, then append what is new.

    Returns per row: doc_id, keep_id, group_size (rows of this load with that text), kept, text_sha256. Of equal texts
    in a load the row with the most code points, then the smallest doc_id stays; a text that the index already has keeps
    the index's keep_id, and of the load only rows with that doc_id are kept: a load that is run again gives the same
    rows and appends nothing. With ``better`` a row that beats the index's takes its place, for this and later loads. A
    null text counts as empty, a null doc_id ranks after all others of its length. Rows that repeat a doc_id with the same
    text are one group: each counts in group_size and each that carries keep_id is kept. Other columns, whatever their
    names, are not read. An empty load returns no rows.
    """
    rows = stage(digests(docs), "digests")
    absorb(rows, index, better)
    return kept_rows(rows, index)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(_best("n_chars", "doc_id").alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")


def absorb(rows: DataFrame, index: DigestIndex, better: bool = False) -> None:
    """Append the digests of rows (which digests() made) that the index lacks, and with ``better`` those whose row beats the index's."""
    groups = stage(_groups(rows), "groups")
    new = stage(index.unseen(groups).unionByName(index.beaten(groups)) if better else index.unseen(groups), "unseen")
    index.append(new)
    for made in (groups, new):
        discard(made)


def kept_rows(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """What the index says of rows that it has absorbed."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    known = stage(sizes.join(index.rows().select("digest", "keep_id").hint("merge"), "digest"), "known")
    out = lookup_join(rows, known, ["digest"], "group_size", rows.count(), F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two loads by doc_id, so that the second one meets digests of the first and may beat their rows; then what the index says of all. The index goes at the end."""
    rows = stage(digests(table(spark, sf_dir, "documents")), "digests")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", expected=rows.count())
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in (0, 1):
        absorb(rows.filter(half == k), index, better=True)
    out = stage(kept_rows(rows, index), "kept")
    index.drop()
    discard(rows)
    return out


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS n_chars, sha256(regexp_replace(text, '[ \t\n\x0b\x0c\r]', '', 'g')) AS text_sha256 FROM d),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
