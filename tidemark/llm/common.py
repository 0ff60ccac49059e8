"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds over 1/HOT of the rows is hot; fewer than HOT keys can be.
HOT = 2000


def free_name(base: str, columns: list[str]) -> str:
    """base, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The temporary folder of each local application that sets no shared one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Local sessions that leave it unset get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[key]


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete what stage() wrote, once nothing will read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with lookup, which has one row per key; weight counts the rows of its key, total counts all rows.

    Hot keys (over total / HOT rows, so fewer than HOT of them) are broadcast and their rows never meet in one
    partition; all others are joined by a shuffle. ``spread`` is any column that varies within a key: it deals out hot
    rows, and rows whose key is null, over the shuffle's partitions.
    """
    fields = [c for c in lookup.columns if c not in keys]
    hot = F.col(weight) * HOT > total
    heavy = lookup.filter(hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*fields).alias("_heavy"))
    # A literal 0 would be folded into a filter on the rows and leave the hash of the shuffle; no weight is negative.
    zero = F.when(F.col(weight) < 0, 1).otherwise(0).cast("int")
    light = lookup.filter(~hot).select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.struct(*fields).alias("_light"), zero.alias("_l_salt"))
    out = rows.join(F.broadcast(heavy), [rows[k] == heavy[f"_h_{k}"] for k in keys], "left").drop(*[f"_h_{k}" for k in keys])
    settled = F.col("_heavy").isNotNull()
    for k in keys:
        settled = settled | F.col(k).isNull()
    out = out.withColumn("_salt", F.when(settled, 1 + F.pmod(F.xxhash64(spread), F.lit(100_003))).otherwise(0).cast("int"))
    out = out.join(light, [out[k] == light[f"_l_{k}"] for k in keys] + [out["_salt"] == light["_l_salt"]], "left")
    got = F.coalesce(F.col("_heavy"), F.col("_light"))
    return out.select(*rows.columns, *[got[c].alias(c) for c in fields])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of each node of the edges, by alternating large-star and small-star rounds; component is the least node.

    Every round is joins and aggregates over the edges, written to the shared folder; nothing but two totals reaches
    the driver. Nodes with very many edges are split by lookup_join.
    """

    def totals(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    e = stage(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    was = totals(e)
    while was[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
        large = lookup_join(both, least, ["u"], "w", 2 * was[0], F.col("v")).filter("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, "edges")
        n = large.count()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count("*").alias("w"))
        small = lookup_join(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")), least, ["u"], "w", n, F.col("v"))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        new = stage(small.select("e.*").filter("hi != lo").distinct(), "edges")
        now = totals(new)
        discard(e)
        discard(large)
        e = new
        if now == was:
            break
        was = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
