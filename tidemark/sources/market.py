"""Stores of bars in day partitions, and text sources and sinks.

A store is Parquet under asset_type=/period=/trade_date=: scans of a range read only its partitions, and a load writes
again only the days that it has rows for. Nothing here opens files by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import Scratch, exists

#: Fixed aliases of the columns of bars.
ALIASES = {
    "date": ("date", "datetime", "日期", "时间", "trade_date"),
    "open": ("open", "开盘", "开盘价"),
    "high": ("high", "最高", "最高价"),
    "low": ("low", "最低", "最低价"),
    "close": ("close", "收盘", "收盘价", "latest_price"),
    "volume": ("volume", "vol", "成交量"),
    "amount": ("amount", "turnover", "成交额"),
}


def normalised(df: DataFrame) -> DataFrame:
    """Columns by their usual names, prices and sizes as doubles (null where they are no numbers); of several aliases the first counts, other columns stay."""
    lower = {c.lower(): c for c in df.columns}
    picked = {name: next((lower[a] for a in names if a in lower), None) for name, names in ALIASES.items()}
    rest = [c for c in df.columns if c not in picked.values() and c not in picked]
    made = [F.to_date(F.col(c)).alias("date") if name == "date" else F.col(c).try_cast("double").alias(name) for name, c in picked.items() if c]
    return df.select(*rest, *made)


def write_days(bars: DataFrame, path: str, asset_type: str, period: str = "daily", keys: tuple[str, ...] = ("symbol", "date"), files: int = 4) -> None:
    """Merge bars (date, ...) into their day partitions: rows with the keys of a new one go, all others of the day stay.

    Only the days that come up are read and written again; of new rows with the same keys any one stays. A day is dealt to
    ``files`` tasks by its first key, so that none holds a whole day of all symbols. The merged days are written apart first: until
    the last moment the old ones are there. Null keys are equal to each other.
    """
    spark = bars.sparkSession
    marks = {"asset_type": F.lit(asset_type), "period": F.lit(period), "trade_date": F.to_date("date")}
    new = bars.dropDuplicates(list(keys)).select(*[c.alias(k) for k, c in marks.items()], *bars.columns)
    with Scratch(spark) as scratch:
        new = scratch.table(new, "load")
        if exists(spark, path):
            days = [r.trade_date for r in new.select("trade_date").distinct().collect()]  # the partitions that are written again
            old = spark.read.schema(new.schema).parquet(path).filter((F.col("asset_type") == asset_type) & (F.col("period") == period) & F.col("trade_date").isin(days))
            same = None
            for k in keys:
                eq = old[k].eqNullSafe(new[k])
                same = eq if same is None else same & eq
            kept = old.join(new.select("trade_date", *keys), (old["trade_date"] == new["trade_date"]) & same, "left_anti")
            new = scratch.table(new.unionByName(kept), "merged")
        out = new.repartition("trade_date", F.pmod(F.xxhash64(keys[0]), F.lit(files)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*marks).parquet(path)


def read_range(spark: SparkSession, path: str, asset_type: str, start: str, end: str, period: str = "daily", symbols: list[str] | None = None) -> DataFrame:
    """The bars of a range; partition columns prune the scan, symbols are pushed down."""
    out = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    out = out.filter((F.col("asset_type") == asset_type) & (F.col("period") == period) & F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if symbols:
        out = out.filter(F.col("symbol").isin(symbols))
    return out.drop("asset_type", "period", "trade_date")


def closest_days(asks: DataFrame, days: DataFrame, within: int = 30) -> DataFrame:
    """asks (day) with the newest stored day (days: trade_date) up to it and less than ``within`` days before; a day meets ``within`` stored days at most."""
    reach = days.select("trade_date", F.explode(F.sequence(F.col("trade_date"), F.date_add("trade_date", within - 1))).alias("day"))
    return asks.join(reach.groupBy("day").agg(F.max("trade_date").alias("trade_date")), "day", "left")


def append_unseen(new: DataFrame, path: str, keys: list[str], at: str | None = None) -> None:
    """Append the rows whose keys the table at path lacks, one per key; the table is made if it is not there.

    Null keys are equal to each other. With ``at``, a key in time, only the table's rows within the load's range of it are read.
    """
    spark = new.sparkSession
    new = new.dropDuplicates(keys)
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).select(*keys)
        if at:
            first, last = new.agg(F.min(at), F.max(at)).first()
            old = old.filter(F.col(at).isNull() | (F.col(at).between(F.lit(first), F.lit(last)) if first is not None else F.lit(False)))
        same = new[keys[0]].eqNullSafe(old[keys[0]])
        for k in keys[1:]:
            same = same & new[k].eqNullSafe(old[k])
        new = new.join(old, same, "left_anti")
    new.write.mode("append").parquet(path)


def validation(bars: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, nulls, crossed, repeated): rows, rows with a missing price, with high under low or a close outside, and beyond one per date."""
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    crossed = (F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))
    n = F.count("*")
    return bars.groupBy(*by).agg(n.alias("rows"), F.count(F.when(missing, 1)).alias("nulls"), F.count(F.when(crossed, 1)).alias("crossed"), (n - F.count_distinct("date")).alias("repeated"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header; fields that don't parse are null."""
    return spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE")


def read_json_lines(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Rows of JSON lines, or of arrays if ``whole``; bad lines are passed over."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED", multiLine=whole)


def write_json_lines(rows: DataFrame, path: str, day: Column) -> None:
    """Append rows as JSON lines to a folder per day."""
    rows.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").json(path)
