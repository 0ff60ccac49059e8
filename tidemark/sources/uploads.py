"""Uploaded files of unknown layout: JSON envelopes, JSON arrays and CSV become VARIANT rows, then one table of typed rows and one of rejects with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import ALIASES

#: Names under which an envelope keeps its rows.
ROWS = ("data", "records", "klines", "rows")
#: A CSV field: quoted, with doubled quotes inside, or plain.
_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^",]*)'

#: The columns of uploaded bars and of uploaded Greeks: type, names in a row or in its envelope.
BARS = {"symbol": ("string", ("symbol", "code", "代码")), "period": ("string", ("period",)), "time": ("string", ("time", *ALIASES["date"]))} | {c: ("double", ALIASES[c]) for c in ("open", "high", "low", "close", "volume")}
GREEKS = {"contract": ("string", ("contract_code", "contract")), "time": ("string", ("time", "timestamp", "采集时间"))} | {c.lower(): ("double", (c, c.lower())) for c in ("Delta", "Gamma", "Theta", "Vega")} | {"iv": ("double", ("隐含波动率", "IV", "iv"))}


def _fields(line: Column) -> Column:
    """The fields of a CSV line, unquoted; a line break within quotes is not known."""
    quoted = lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(F.trim(x)))


def _record(header: Column, cells: Column) -> Column:
    """The VARIANT of a CSV line's cells by the header; null if it has another width."""
    return F.when(F.size(cells) == F.size(header), F.try_parse_json(F.to_json(F.map_from_arrays(header, cells))))


def _bound(**made: Column) -> Column:
    """Columns of a generator of their own: nothing that uses or filters them is merged with it, so each is made once a row, and in
    generated code (a chain of lambdas would be interpreted)."""
    return F.inline_outer(F.array(F.struct(*[x.alias(name) for name, x in made.items()])))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, layout, envelope, pos, row) of the files under path: a VARIANT row for each record, and for what cannot be read one row that is null; envelope is a map of what stands beside the records.

    A file that starts with a brace or a bracket is JSON: an array of records, or an envelope with such an array under one
    of ROWS. Any other is CSV with a header. A file is one string of a task, so its size is bounded by the
    uploads: what is larger comes in several files of one folder.
    """
    folder = F.get(F.split("_metadata.file_path", "/"), F.size(F.split("_metadata.file_path", "/")) - 2)
    files = spark.read.text(path, wholetext=True).select(folder.alias("folder"), F.col("_metadata.file_name").alias("file"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("text"))
    files = files.withColumn("json", F.col("text").rlike(r"^\s*[\[{]"))
    # What an envelope says beside its rows, and its layout, are small and made before the rows are: a row must not carry its file.
    said = F.map_filter(F.from_json("text", "map<string,string>"), lambda k, v: ~k.isin(*ROWS) & ~v.rlike(r"^\s*[\[{]"))
    parsed = files.filter("json").select("folder", "file", F.try_parse_json("text").alias("whole"), said.alias("said"))
    array = F.schema_of_variant("whole").startswith("ARRAY")
    layout = F.when(F.col("whole").isNull(), "broken").when(array, "array").otherwise("envelope")
    inside = F.coalesce(*[F.try_variant_get("whole", f"$.{name}", "variant") for name in ROWS], F.when(array, F.col("whole")))
    parsed = parsed.select("folder", "file", layout.alias("layout"), F.when(layout == "envelope", F.col("said")).alias("envelope"), inside.alias("inside"))
    parsed = parsed.select("folder", "file", "layout", "envelope", F.when(F.schema_of_variant("inside").startswith("ARRAY"), F.col("inside")).alias("rows"))
    json = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("rows").outer())).select("folder", "file", "layout", "envelope", "pos", F.col("value").alias("row"))
    lines = files.filter("NOT json").select("folder", "file", F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    csv = lines.withColumn("header", _fields(F.get("lines", 0))).select("folder", "file", "header", F.posexplode_outer(rest).alias("pos", "line"))
    csv = csv.select("folder", "file", "header", "pos", _bound(cells=_fields(F.col("line"))))
    csv = csv.select("folder", "file", "pos", _bound(row=_record(F.col("header"), F.col("cells"))))
    csv = csv.select("folder", "file", F.lit("csv").alias("layout"), F.lit(None).cast("map<string,string>").alias("envelope"), "pos", "row")
    return json.union(csv)


def merged_schema(uploads: DataFrame) -> DataFrame:
    """(layout, schema): what the records of each layout have in common, by all files."""
    return uploads.filter("row IS NOT NULL").groupBy("layout").agg(F.schema_of_variant_agg("row").alias("schema"))


def _text(record: Column, envelope: Column, aliases: tuple[str, ...]) -> Column:
    """The text under the first alias that the record has, else its envelope."""
    return F.coalesce(*[F.try_element_at(x, F.lit(a)) for x in (record, envelope) for a in aliases])


def typed(uploads: DataFrame, columns: dict[str, tuple[str, tuple[str, ...]]], required: list[str], time: str = "time") -> DataFrame:
    """(folder, file, layout, pos, *columns, reason): reason is null for a good row, else why it is rejected.

    Reasons: ``not read`` (no JSON, or a CSV line of another width than its header), ``no rows``, ``missing`` and the required
    columns that have no value, ``no number`` and the columns whose text is none, ``no time``. Times are digits
    (yyyyMMdd, yyyyMMddHHmmss) or ISO.
    """
    unquoted = lambda x: F.trim(F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    listed = lambda tests: F.concat_ws(" ", *[F.when(t, F.lit(c)) for c, t in tests])
    # Each step binds what the next one uses, and a filter on what comes out stays above the last one: nothing is found or parsed twice.
    # A step that takes over all columns of the one before becomes a method of its own; in one method they are too long for the JVM to compile.
    kept, texts, values = ["folder", "file", "layout", "pos", "_null"], {c: F.col(f"_text_{c}") for c in columns}, {c: F.col(f"_value_{c}") for c in columns}
    rows = uploads.select(*kept[:-1], "envelope", _bound(_null=F.col("row").isNull(), _record=F.try_variant_get("row", "$", "map<string,string>")))
    rows = rows.select(*kept, _bound(**{f"_text_{c}": _text(F.col("_record"), F.col("envelope"), aliases) for c, (_, aliases) in columns.items()}))
    rows = rows.select(*kept, *texts.values(), _bound(**{f"_value_{c}": unquoted(texts[c]) if kind == "string" else texts[c].try_cast(kind) for c, (kind, _) in columns.items()}))
    rows = rows.select("*", _bound(_digits=F.regexp_replace(values[time], r"\D", "")))
    digits = F.col("_digits")
    at = F.coalesce(*[F.try_to_timestamp(F.when(F.length(digits) == len(form), digits), F.lit(form)) for form in ("yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss")])
    rows = rows.select(*kept, *texts.values(), *values.values(), _bound(_at=at))
    values[time] = F.col("_at")
    broken = listed([(c, texts[c].isNotNull() & values[c].isNull()) for c, (kind, _) in columns.items() if kind != "string"])
    absent = listed([(c, texts[c].isNull()) for c in required])
    rows = rows.select(*kept, *values.values(), _bound(_absent=absent, _broken=broken))
    unread = F.when(F.col("layout").isin("broken") | F.col("pos").isNotNull(), "not read").otherwise("no rows")
    reason = F.when(F.col("_null"), unread).when(F.col("_absent") != "", F.concat(F.lit("missing "), "_absent")).when(F.col("_broken") != "", F.concat(F.lit("no number "), "_broken")).when(F.col("_at").isNull(), "no time")
    found = [(F.when(x != "", x) if columns[c][0] == "string" and c != time else x).alias(c) for c, x in values.items()]
    return rows.select("folder", "file", "layout", "pos", *found, _bound(reason=reason))


def bars_and_rejects(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of all layouts, rejects)."""
    rows = typed(uploads, BARS, ["symbol", "time", "open", "high", "low", "close", "volume"])
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("folder", "file", "layout", "pos", "reason")
