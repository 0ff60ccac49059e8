"""Selections from end to end: universes, the rotation pipeline, screening pools merged, gated and limited."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.folder import Scratch
from . import rotation as R
from .scoring import FACTORS, weighted


def universe(sources: list[DataFrame], most: int | None = None) -> DataFrame:
    """(symbol, source, place) of ordered lists (symbol, position): the first of equal symbols stays, in the order of the lists; at most ``most`` of them."""
    every = None
    for k, rows in enumerate(sources):
        one = rows.select(F.trim("symbol").alias("symbol"), F.struct(F.lit(k).alias("source"), F.col("position").cast("long").alias("position")).alias("at")).filter("symbol IS NOT NULL AND symbol != ''")
        every = one if every is None else every.union(one)
    first = every.groupBy("symbol").agg(F.min("at").alias("at"))
    out = first.select("symbol", F.col("at.source").alias("source"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at", "symbol")).alias("place"))
    return out if most is None else out.filter(F.col("place") <= most)


def enriched(rows: DataFrame, key: str, lookups: list[DataFrame], names: list[str]) -> DataFrame:
    """rows with each of names from the first lookup (key, *names) that has a value for it, not null and not blank; a lookup has one row for a key."""
    out = rows
    for k, lookup in enumerate(lookups):
        out = out.join(lookup.select(key, *[F.col(n).alias(f"_{n}_{k}") for n in names]), key, "left")
    made = {n: F.coalesce(*[F.when(F.trim(F.col(f"_{n}_{k}").cast("string")) != "", F.col(f"_{n}_{k}")) for k in range(len(lookups))]) for n in names}
    return out.withColumns(made).drop(*[f"_{n}_{k}" for n in names for k in range(len(lookups))])


# --- rotation

_MODES = ("off", "soft", "hard")


@dataclass(frozen=True)
class RotationRules:
    """What excludes a symbol (hard), what lowers its score (soft), and how correlation counts: off, penalize, filter (by mean) or filter_greedy (by pairs)."""

    ma: str = "soft"
    ma_penalty: float = 0.85
    volatility: str = "soft"
    volatility_range: tuple[float, float] = (0.0, 15.0)
    volatility_penalty: float = 0.9
    drawdown: str = "hard"
    drawdown_least: float = -0.25
    drawdown_penalty: float = 0.9
    crowding_soft: float | None = 0.9
    crowding_penalty: float = 0.95
    crowding_hard: float | None = None
    correlation: str = "filter_greedy"
    mean_most: float = 0.85
    pair_most: float = 0.7
    weights: dict[str, float] = field(default_factory=lambda: dict(R.WEIGHTS))
    least: int = 5

    def __post_init__(self) -> None:
        if {self.ma, self.volatility, self.drawdown} - set(_MODES) or self.correlation not in ("off", "penalize", "filter", "filter_greedy"):
            raise ValueError("no such mode")


def judged(metrics: DataFrame, rules: RotationRules) -> DataFrame:
    """metrics with reason (why a symbol is out, the last rule that says so; null: it is in) and penalty (the product of the soft ones)."""
    c = F.col
    low, high = rules.volatility_range
    wild, deep = (c("vol20") < low) | (c("vol20") > high), c("mdd60") < rules.drawdown_least
    hard = [(c("m60").isNull(), "short_history")]
    hard += [(~c("above_ma"), "below_ma")] * (rules.ma == "hard") + [(wild, "volatility")] * (rules.volatility == "hard") + [(deep, "drawdown")] * (rules.drawdown == "hard")
    hard += [(c("mean_corr") > rules.mean_most, "high_mean_corr")] * (rules.correlation == "filter")
    if rules.crowding_hard is not None:
        hard.append((c("crowding") >= rules.crowding_hard, "crowding"))
    reason = F.lit(None).cast("string")
    for test, name in hard:
        reason = F.when(test, name).otherwise(reason)
    soft = [(~c("above_ma"), rules.ma_penalty)] * (rules.ma == "soft") + [(wild, rules.volatility_penalty)] * (rules.volatility == "soft") + [(deep, rules.drawdown_penalty)] * (rules.drawdown == "soft")
    if rules.crowding_soft is not None:
        soft.append((c("crowding") >= rules.crowding_soft, rules.crowding_penalty))
    penalty = F.lit(1.0)
    for test, share in soft:
        penalty = penalty * F.when(test, share).otherwise(1.0)
    return metrics.withColumns({"reason": reason, "penalty": penalty})


def rotation(bars: DataFrame, pools: DataFrame, rules: RotationRules, runs: DataFrame | None = None, engine: Column | None = None) -> DataFrame:
    """(symbol, pool, rank, pool_rank, score, penalty, reason) of every symbol of pools (symbol, pool) that has bars.

    Bars are read once and written apart; metrics, correlations and stability (from ranked lists of earlier ``runs``; .5
    without any) meet in one row a symbol. Those that no rule excludes are ranked within their pool by the weighted ranks of
    their metrics, times their penalties, and over all pools. ``engine`` is the score that the greedy correlation filter
    goes by, the composite one if it is not given. Excluded symbols have a reason, no score and no rank.
    """
    with Scratch(bars.sparkSession) as scratch:
        bars = scratch.table(bars.join(pools.select("symbol"), "symbol", "left_semi"), "bars")
        pairs = scratch.table(R.correlations(R.log_returns(bars)), "pairs")
        metrics = R.base_metrics(bars).join(pools, "symbol").join(R.mean_abs_correlation(pairs), "symbol", "left")
        metrics = metrics.withColumn("mean_corr", F.coalesce("mean_corr", F.lit(0.0)))
        steady = R.stability(runs) if runs is not None else None
        metrics = metrics.join(steady, "symbol", "left").withColumn("stability", F.coalesce("stability", F.lit(0.5))) if steady is not None else metrics.withColumn("stability", F.lit(0.5))
        weights = FACTORS if rules.correlation == "penalize" else {k: v for k, v in FACTORS.items() if k != "mean_corr"}
        rows = scratch.table(judged(metrics, rules).withColumn("_pre", (engine if engine is not None else weighted(weights)) * F.col("penalty")), "judged")
        if rules.correlation == "filter_greedy":
            ordered = rows.filter("reason IS NULL").select(F.lit(0).alias("pool"), "symbol", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_pre"), "symbol")).alias("rank"))
            kept = R.greedy_filter(ordered, pairs, rules.pair_most).select("symbol", F.lit(True).alias("_kept"))
            rows = rows.join(kept, "symbol", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_kept").isNull(), "correlated").otherwise(F.col("reason")))
        ranked = R.pool_ranks(rows.filter("reason IS NULL").drop("rank", "score"), "pool", rules.weights).withColumn("score", F.col("score") * F.col("penalty"))
        over = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.round("score", 10).desc(), "symbol"))
        ranked = ranked.select("symbol", "score", over(F.lit(0)).alias("rank"), over("pool").alias("pool_rank"))
        out = rows.join(ranked, "symbol", "left").select("symbol", "pool", "rank", "pool_rank", "score", "penalty", "reason")
        return Scratch(bars.sparkSession).table(out, "rotation", keep=True)


def rotation_readiness(pools: DataFrame, ranking: DataFrame, least: int = 5) -> DataFrame:
    """(pool, total, available, degraded): symbols asked for, and those that ended with a rank; a pool with fewer than ``least`` is degraded."""
    got = ranking.filter("rank IS NOT NULL").groupBy("pool").agg(F.count("*").alias("available"))
    out = pools.groupBy("pool").agg(F.count("*").alias("total")).join(got, "pool", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return out.withColumn("degraded", F.col("available") < least)


# --- screening

#: Blocks of a pool's rows whose best scores bound the pool's.
SPREAD = 1000


def _leading(rows: DataFrame, name: str) -> Column:
    """What orders a column as it is ordered itself, but for ties: of texts their first seven bytes as a number, as the least text of a group would be found by a sort."""
    if rows.schema[name].dataType != StringType():
        return F.col(name)
    return F.conv(F.rpad(F.substring(F.hex(F.col(name)), 1, 14), 14, "0"), 16, 10).cast("long")


def contenders(rows: DataFrame, most: int) -> DataFrame:
    """Of rows (paradigm, _side, symbol, _key) those that can be among a paradigm's and side's first ``most`` by _key, best first, and symbol; found without a sort of rows.

    Of SPREAD blocks of each, at least ``most`` have a row with the _key of the block that is ``most``-th by its best one: rows
    under it are left out. Of rows with just that _key as many blocks' first symbols bound the symbols in the same way.
    """
    block = F.pmod(F.xxhash64("symbol"), F.lit(SPREAD)).alias("_b")

    def bounded(rows: DataFrame, best: DataFrame, order: Column, value: str) -> DataFrame:
        """rows with the value of their paradigm's and side's ``most``-th block."""
        nth = F.row_number().over(Window.partitionBy("paradigm", "_side").orderBy(order, "_b"))
        least = best.withColumn("_n", nth).filter(F.col("_n") == most).select(F.col("paradigm").alias("_p"), F.col("_side").alias("_s"), value)
        return rows.join(F.broadcast(least), rows["paradigm"].eqNullSafe(least["_p"]) & (rows["_side"] == least["_s"]), "left").drop("_p", "_s")

    out = rows.withColumn("_sym", _leading(rows, "symbol"))
    out = bounded(out, out.groupBy("paradigm", "_side", block).agg(F.max("_key").alias("_least")), F.desc("_least"), "_least")
    out = out.filter(F.col("_least").isNull() | (F.col("_key") >= F.col("_least")))
    tie = F.col("_key").eqNullSafe(F.col("_least"))
    out = bounded(out, out.filter(tie).groupBy("paradigm", "_side", block).agg(F.min("_sym").alias("_last")), F.asc_nulls_last("_last"), "_last")
    return out.filter(~tie | F.col("_last").isNull() | F.col("_sym").isNull() | (F.col("_sym") <= F.col("_last"))).drop("_sym", "_least", "_last")


def pooled(scored: DataFrame, entry: dict[str, float], multiplier: Column, degraded: Column, relief: float = 8.0, most: int = 10) -> DataFrame:
    """(paradigm, symbol, class, amount, score, place, fallback) of gated rows (paradigm, symbol, class, amount, score): each paradigm's best ``most``.

    Scores are multiplied by the market's ``multiplier``. A row needs its paradigm's ``entry`` score, lowered by ``relief``
    where its features are ``degraded``; a paradigm that nobody enters takes its ten best anyway.
    """
    bar = F.coalesce(*[F.when(F.col("paradigm") == k, F.lit(float(v))) for k, v in entry.items()], F.lit(0.0)) - F.when(degraded, relief).otherwise(0.0)
    out = scored.withColumn("score", F.col("score") * multiplier).withColumn("_in", F.col("score") >= bar)
    # The best of those that enter and the best of the others.
    out = contenders(out.withColumns({"_side": F.coalesce("_in", F.lit(False)), "_key": F.round("score", 10)}), most)
    place = F.row_number().over(Window.partitionBy("paradigm", "_side").orderBy(F.desc("_key"), "symbol"))
    out = out.withColumn("place", place).filter(F.col("place") <= most)
    any_ = F.max(F.col("_in").cast("int")).over(Window.partitionBy("paradigm")) == 1
    out = out.withColumn("fallback", ~any_).filter(F.col("_in") | F.col("fallback"))
    return out.select("paradigm", "symbol", "class", "amount", "score", "place", "fallback")


def merged_pools(pools: DataFrame, bonus: float = 4.0, most_bonus: float = 12.0, k: int = 5, cap: int = 2) -> DataFrame:
    """(symbol, class, primary, score, paradigms, place, tags): symbols of several pools as one, the best ``k`` with at most ``cap`` of a class, and each pool's first.

    A symbol's score is its best one, ``bonus`` for each further pool up to ``most_bonus``, and up to 2 for its amount (of 5e8);
    its primary paradigm is that of the best score (ties: by name), whose row gives class and amount. Tags: top, and first
    of a pool. Of the pool firsts that the caps leave out, the place is null.
    """
    ranked = pools.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.round("score", 10).desc(), "paradigm")))
    out = ranked.groupBy("symbol").agg(F.min(F.when(F.col("_n") == 1, F.struct("paradigm", "class", "amount", "score"))).alias("b"), F.count("*").alias("n"), F.sort_array(F.collect_set("paradigm")).alias("paradigms"), F.max((F.col("place") == 1).cast("int")).alias("first"))
    score = F.col("b.score") + F.least(F.lit(most_bonus), (F.col("n") - 1) * bonus) + F.least(F.lit(2.0), F.coalesce(F.col("b.amount"), F.lit(0.0)) / 5e8 * 2)
    out = out.select("symbol", F.col("b.class").alias("class"), F.col("b.paradigm").alias("primary"), score.alias("score"), "paradigms", "first")
    order = [F.round("score", 10).desc(), F.col("symbol")]
    of_class = F.row_number().over(Window.partitionBy("class").orderBy(*order))
    inside = out.withColumn("_c", of_class).withColumn("_ok", F.col("_c") <= cap)
    place = F.row_number().over(Window.partitionBy("_ok").orderBy(*order))
    inside = inside.withColumn("place", F.when(F.col("_ok"), place)).withColumn("place", F.when(F.col("place") <= k, F.col("place")))
    tags = F.filter(F.array(F.when(F.col("place").isNotNull(), "top"), F.when(F.col("first") == 1, "first")), lambda x: x.isNotNull())
    return inside.filter("place IS NOT NULL OR first = 1").select("symbol", "class", "primary", "score", "paradigms", "place", tags.alias("tags"))


def weekly_limited(picks: DataFrame, most: int = 2) -> DataFrame:
    """picks (symbol, date, place) with allowed: at most ``most`` picks of a symbol count in the seven days up to each.

    Picks that were held back do not count, so that a symbol's picks are folded in time; a symbol has one pick a day.
    """
    rows = picks.groupBy("symbol").agg(F.sort_array(F.collect_set(F.to_date("date"))).alias("days"))
    empty = F.array().cast("array<date>")
    recent = lambda s, d: F.size(F.filter(s, lambda x: F.date_diff(d, x) < 7))
    step = lambda a, d: F.when(recent(a["kept"], d) < most, F.struct(F.concat(F.filter(a["kept"], lambda x: F.date_diff(d, x) < 7), F.array(d)).alias("kept"), F.concat(a["all"], F.array(d)).alias("all"))).otherwise(a)
    folded = rows.select("symbol", F.aggregate("days", F.struct(empty.alias("kept"), empty.alias("all")), step, lambda a: a["all"]).alias("allowed_days"))
    return picks.join(folded, "symbol").withColumn("allowed", F.array_contains("allowed_days", F.to_date("date"))).drop("allowed_days")


def watchlist(old: DataFrame, new: DataFrame, least: float = 0.0) -> DataFrame:
    """(symbol, score, added, updated) of the stored list and new rows (symbol, score, date): known symbols keep the day they were added; rows without a symbol, or with a score that is missing or under ``least``, are not valid."""
    valid = new.filter(F.col("symbol").isNotNull() & (F.trim("symbol") != "") & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least))
    both = old.select("symbol", "score", "added", "updated").union(valid.select("symbol", "score", F.col("date").alias("added"), F.col("date").alias("updated")))
    return both.groupBy("symbol").agg(F.max_by("score", F.struct("updated", "score")).alias("score"), F.min("added").alias("added"), F.max("updated").alias("updated"))


def screening_gate(rows: DataFrame, by: list[str], least: int = 3, most_missing: float = 0.4) -> DataFrame:
    """(by, n, missing_share, quality, reason) of candidates (by, score, amount): failed without any, degraded with fewer than ``least`` or too many missing amounts, else ok."""
    out = rows.groupBy(*by).agg(F.count("score").alias("n"), F.avg(F.col("amount").isNull().cast("int")).alias("missing_share"))
    few, bare = F.col("n") < least, F.col("missing_share") > most_missing
    reason = F.array_join(F.filter(F.array(F.when(F.col("n") == 0, "empty").when(few, "few_candidates"), F.when(bare, "missing_amounts")), lambda x: x.isNotNull()), ",")
    return out.withColumns({"quality": F.when(F.col("n") == 0, "failed").when(few | bare, "degraded").otherwise("ok"), "reason": reason})


# --- reports


def market_report(trends: DataFrame, bars: DataFrame, first: str, second: str, overnight: DataFrame | None = None) -> DataFrame:
    """(date, first_trend, second_trend, up, down, ratio, score, trend, and before an opening impact, outlook) by date.

    trends: (symbol, date, trend) of indices; bars give the breadth over all symbols. After the close, the two indices'
    trends and the share of rising symbols make the overall trend. ``overnight`` (date, impact) adds what the night has done:
    the outlook is the score moved by a tenth of the impact, strong from .7 on and weak to .3.
    """
    from ..functions.windows import series
    from .scoring import overall_trend_score, trend_label

    move = bars.select("date", (F.col("close") - F.lag("close").over(series("symbol"))).alias("d")).filter("d IS NOT NULL")
    breadth = move.groupBy("date").agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down"), F.avg((F.col("d") > 0).cast("int")).alias("_rising"))
    one = lambda symbol, name: trends.filter(F.col("symbol") == symbol).select("date", F.col("trend").alias(name))
    out = one(first, "first_trend").join(one(second, "second_trend"), "date").join(breadth, "date")
    out = out.withColumn("score", F.round(overall_trend_score(F.col("first_trend"), F.col("second_trend"), F.col("_rising")), 6)).drop("_rising")
    out = out.withColumns({"ratio": F.when(F.col("up") + F.col("down") > 0, F.col("up") / (F.col("up") + F.col("down"))), "trend": trend_label(F.col("score"))["trend"]})
    if overnight is None:
        return out
    out = out.join(overnight, "date", "left")
    return out.withColumn("outlook", trend_label(F.round(F.col("score") + F.coalesce("impact", F.lit(0.0)) * 0.1, 6))["trend"])


def scenarios(direction: Column, impact: Column, parts: dict[str, Column]) -> dict[str, Column]:
    """optimistic, neutral and pessimistic: the conditions that hold for each, from the direction of flows, the overnight impact (beyond .15) and what else is there."""
    flow = F.when(direction.isNotNull(), F.concat(F.lit("flow "), direction))
    up, down = F.when(impact > 0.15, F.concat(F.lit("impact "), impact.cast("string"))), F.when(impact < -0.15, F.concat(F.lit("impact "), impact.cast("string")))
    middle = F.when(~F.coalesce((impact > 0.15) | (impact < -0.15), F.lit(False)), "impact near the middle or unknown")
    listed = lambda *xs: F.array_join(F.array_compact(F.array(*xs)), "; ")
    turned = (F.when(impact < -0.15, "unless impact turns up"), F.when(impact > 0.15, "unless impact turns down"))
    return {"optimistic": listed(flow, up, turned[0]), "neutral": listed(flow, middle, *[F.when(x.isNotNull(), F.lit(f"given {k}")) for k, x in parts.items()]), "pessimistic": listed(flow, down, turned[1])}
