"""Predictions recorded from a stream and completed by a second one: micro-batches are merged into day partitions.

A batch touches only the days that it has rows for. Its id is noted once it is in, and a merge keeps one row for each key,
so that a batch that is run again, under its id or another one, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import Scratch, exists

#: What is stored of a prediction; its day is the partition.
COLUMNS = "id string, symbol string, source string, method string, made_at timestamp, price double, lower double, upper double, confidence double, usable boolean, actual_high double, actual_low double, actual_close double, verified boolean, hit boolean, day date"
KEY = ["day", "id"]
_ACTUAL = ("actual_high", "actual_low", "actual_close")


def _note(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True).close()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The predictions that the store has, none if it is not there."""
    return spark.read.schema(COLUMNS).parquet(path) if exists(spark, path) else spark.createDataFrame([], COLUMNS)


def _days_of(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store's partitions that a batch touches."""
    return store.filter(F.col("day").isin([r.day for r in batch.select("day").distinct().collect()]))  # a batch's days, bounded by its size


def _merge(path: str, kind: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the days that a batch touches become change(their rows, the batch)."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/_batches/{kind}-{batch_id}"
        if exists(spark, done):
            return
        with Scratch(spark) as scratch:
            new = scratch.table(batch, "batch")
            merged = scratch.table(change(_days_of(stored(spark, path), new), new), "merged")  # the old rows are there until all new ones are written
            merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        _note(spark, done)

    return put


def with_quality(predictions: DataFrame, policy: str = "mark_invalid") -> DataFrame:
    """predictions with usable: a range whose ends are in order around a positive price. ``policy``: skip_store leaves others out, mark_invalid stores them so, log_only takes them as usable."""
    good = F.coalesce((F.col("price") > 0) & (F.col("lower") <= F.col("price")) & (F.col("price") <= F.col("upper")), F.lit(False))
    if policy not in ("skip_store", "mark_invalid", "log_only"):
        raise ValueError(f"no such policy: {policy}")
    return predictions.filter(good).withColumn("usable", F.lit(True)) if policy == "skip_store" else predictions.withColumn("usable", good if policy == "mark_invalid" else F.lit(True))


def recorder(path: str, policy: str = "mark_invalid") -> Callable[[DataFrame, int], None]:
    """foreachBatch function that stores predictions (id, symbol, source, method, made_at, price, lower, upper, confidence, day).

    Of several rows of an id on a day the last made stays (ties: the least range); a prediction that is verified already
    is not replaced.
    """
    rest = [c.split()[0] for c in COLUMNS.split(", ") if c.split()[0] not in KEY]

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        new = with_quality(batch, policy).withColumns({c: F.lit(None).cast("double") for c in _ACTUAL}).withColumns({"verified": F.lit(False), "hit": F.lit(None).cast("boolean")})
        both = old.unionByName(new.select(*[c.split()[0] for c in COLUMNS.split(", ")]))
        order = F.struct("verified", "made_at", -F.coalesce("lower", F.lit(0.0)), -F.coalesce("upper", F.lit(0.0)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])
        best = both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("x"))
        return best.select("id", *[f"x.{c}" for c in rest], "day").select(*[c.split()[0] for c in COLUMNS.split(", ")])

    return _merge(path, "recorded", change)


def completer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that completes stored predictions with what came (symbol, source, day, actual_high, actual_low, actual_close).

    Every prediction of the symbol, source and day that is not verified yet is; it hits if both extremes lie within its
    range (null where one is missing). Of several actual rows the one with the greatest close counts.
    """

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        actual = batch.groupBy("day", "symbol", "source").agg(F.max_by(F.struct(*_ACTUAL), F.struct("actual_close", "actual_high", "actual_low")).alias("a"))
        out = old.join(actual, ["day", "symbol", "source"], "left")
        fresh = F.col("a").isNotNull() & ~F.col("verified")
        inside = (F.col("a.actual_high") <= F.col("upper")) & (F.col("a.actual_low") >= F.col("lower"))
        out = out.withColumns({"hit": F.when(fresh, inside).otherwise(F.col("hit")), **{c: F.when(fresh, F.col(f"a.{c}")).otherwise(F.col(c)) for c in _ACTUAL}, "verified": F.col("verified") | fresh})
        return out.select(*[c.split()[0] for c in COLUMNS.split(", ")])

    return _merge(path, "completed", change)


def take(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run put over all batches that the checkpoint has not seen."""
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def method_report(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, verified, usable, hit_rate, coverage, mean_width, mean_miss) of stored predictions.

    hit_rate counts usable verified predictions; coverage is the mean share of the actual range that lies within the
    predicted one; mean_miss is how far the close lies outside, in percent of the price.
    """
    judged = F.col("verified") & F.col("usable")
    size = F.col("actual_high") - F.col("actual_low")
    inside = F.greatest(F.lit(0.0), F.least("upper", "actual_high") - F.greatest("lower", "actual_low"))
    covered = F.when(judged & (size > 0), inside / size)
    miss = F.greatest(F.lit(0.0), F.col("lower") - F.col("actual_close"), F.col("actual_close") - F.col("upper")) / F.col("price") * 100
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(F.col("usable"), 1)).alias("usable"), F.avg(F.when(judged, F.col("hit").cast("int"))).alias("hit_rate"),
        F.avg(covered).alias("coverage"), F.avg(F.when(judged & (F.col("price") > 0), (F.col("upper") - F.col("lower")) / F.col("price") * 100)).alias("mean_width"), F.avg(F.when(judged & (F.col("price") > 0), miss)).alias("mean_miss"),
    )
