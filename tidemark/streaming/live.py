"""Structured Streaming: bars from ticks, dedup of late repeats; monitors with state are in ``monitors``.

Each takes a streaming DataFrame and returns one; ``run`` drains what is there into a table, as a scheduled job would,
and ``drained`` does so again and again while the input arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import new_path, remove
from .monitors import STORE


#: Rows of a stream's input to a partition of its state.
ROWS_A_PARTITION = 1_000_000


def take_what_is_there(stream: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> None:
    """One run over all input that the stream's checkpoint under path has not seen, into the Parquet sink beside it.

    State lies in the store that the monitors need. ``partitions`` of the state are fixed by the first run; the session's if not given.
    """
    conf = stream.sparkSession.conf
    held = {"spark.sql.streaming.stateStore.providerClass": STORE} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    was = {k: conf.get(k) for k in held}
    for k, v in held.items():
        conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in was.items():
            conf.set(k, v)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all input that is there now, from a Parquet sink in the shared folder; the checkpoint lies beside it."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    take_what_is_there(stream, path, mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained(spark: SparkSession, arrivals: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``build`` makes of a stream whose input arrives in parts, with a run after each part that starts from the checkpoint of the last one.

    The state has a partition for each ROWS_A_PARTITION rows that are to come, as the first part tells, eight at least and
    the session's number at most: each costs every run a store to open.
    """
    path = new_path(spark, name)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(most, max(8, arrivals[0].count() * len(arrivals) // ROWS_A_PARTITION))
    for part in arrivals:
        part.write.mode("append").parquet(f"{path}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{path}/in"))
        take_what_is_there(stream, path, partitions=partitions)
    out = spark.read.schema(stream.schema).parquet(f"{path}/rows")
    for done in ("in", "checkpoint"):
        remove(spark, f"{path}/{done}")
    return out


def tick_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (symbol, ts, price, volume, id), closed and labelled at the right, once the watermark has passed them."""
    shifted = ticks.withColumn("_t", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_t", late)
    at = F.struct("ts", "id")
    out = shifted.groupBy("symbol", F.window("_t", f"{minutes} minutes").alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades")
    )
    return out.select("symbol", F.col("_w.end").alias("date"), "open", "high", "low", "close", "volume", "trades")


def unseen(rows: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats may come up to ``late`` after it, and the state of a key goes then."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
