"""Fitted forecasts: logistic models, earlier neighbours with calibration, GARCH volatility, ARIMA trends.

Nothing here looks ahead: statistics and weights come from training rows alone, and a row's neighbours and calibration
from rows before it. The logistic fit goes over the rows once for each Newton step, wherever they lie; the time-series
models are fitted one bounded series to a row, so that Spark deals them out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, sigmoid
from ..functions.windows import full, pct_change, series, sma
from ..sources.folder import Scratch
from .bars import tail

# --- logistic models

#: The features of the logistic predictor.
FEATURES = ("ret1", "ret3", "ret5", "ret10", "ret20", "vol_ratio_1d_5d", "volatility_5d", "volatility_20d", "mom_gap_5_20", "ret_accel")
#: Logits are held within this.
MOST_LOGIT = 30.0


def return_features(bars: DataFrame) -> DataFrame:
    """(symbol, date, FEATURES, label, known_at) of bars: label is 1 where the next close is higher, known_at the date of that close.

    The last bar of a symbol has no label (the rule that this follows counts it as a fall, for want of a next close).
    """
    w = series("symbol")
    out = bars.select("symbol", "date", "close", "volume", *[pct_change("close", k, w).alias(f"ret{k}") for k in (1, 3, 5, 10, 20)], sma("volume", 5, w).alias("_v"))
    deviations = [full(F.stddev_samp("ret1"), n, w, F.col("ret1")).alias(f"volatility_{n}d") for n in (5, 20)]
    after = F.lead("close").over(w)
    out = out.select("*", F.when(F.col("_v") != 0, F.col("volume") / F.col("_v")).alias("vol_ratio_1d_5d"), *deviations, (F.col("ret5") - F.col("ret20")).alias("mom_gap_5_20"), (F.col("ret5") - F.col("ret10")).alias("ret_accel"))
    return out.select("symbol", "date", *FEATURES, F.when(after.isNotNull(), (after > F.col("close")).cast("double")).alias("label"), F.lead("date").over(w).alias("known_at"))


def fit_logistic(rows: DataFrame, keys: list[str], features: list[str], label: str, penalty: float = 0.01, least: int = 80, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(keys, n, mean, std, weights, bias, accuracy) of a logistic model for each key with ``least`` complete rows or more.

    Minimises mean cross-entropy + penalty * mean(weights^2) over features scaled by their own mean and deviation (of n).
    Each Newton step is one pass: tasks sum loss, gradient and curvature by key over the rows that they hold, and what
    is shuffled are those sums, of a size that the number of features fixes. A step that raises the loss is halved. The
    models, a row for each key, are joined to the rows, so that Spark chooses by their size whether to broadcast them.
    """
    k = len(features)
    complete = rows.select(*keys, *features, F.col(label).cast("double").alias("_y")).dropna()
    mean = F.array(*[F.avg(F.col(c).cast("double")) for c in features])
    # The deviation of a feature that never moves is rounding, not 0.
    deviation = F.array(*[F.when(F.max(c) > F.min(c), F.stddev_pop(F.col(c).cast("double"))).otherwise(1.0) for c in features])
    zeros = F.array(*[F.lit(0.0)] * (k + 1))
    with Scratch(rows.sparkSession) as scratch:
        stats = complete.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean"), deviation.alias("std")).filter(F.col("n") >= least)
        stats = scratch.table(stats, "scales")
        scaled = [(F.col(c) - F.get("mean", i)) / F.get("std", i) for i, c in enumerate(features)]
        points = scratch.table(complete.join(stats, keys).select(*keys, F.array(*scaled, F.lit(1.0)).alias("x"), "_y"), "points")
        model = stats.select(*keys, "n", zeros.alias("at"), zeros.alias("best"), zeros.alias("move"), F.lit(math.inf).alias("loss"), F.lit(1.0).alias("share"), F.lit(False).alias("done"), F.lit(0.0).alias("accuracy"))
        model = scratch.table(model, "models")
        for _ in range(steps):
            going = model.filter("NOT done")
            if going.isEmpty():
                break
            sums = points.join(going.select(*keys, "at"), keys).mapInArrow(_sums(keys, k), ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys), "sums array<double>"]))
            moved = going.groupBy(*keys).cogroup(sums.groupBy(*keys)).applyInPandas(_newton(k, penalty, tolerance), model.schema)
            model = scratch.table(moved.union(model.filter("done")), "models")
        out = model.join(stats.select(*keys, "mean", "std"), keys)
        return Scratch(rows.sparkSession).table(out.select(*keys, "n", "mean", "std", F.slice("best", 1, k).alias("weights"), F.get("best", k).alias("bias"), "accuracy"), "logistic", keep=True)


def _sums(keys: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch and key: rows, hits, loss, gradient and curvature at the model's point."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, k + 1)
            at = batch.column("at").flatten().to_numpy().reshape(-1, k + 1)
            y = batch.column("_y").to_numpy()
            logit = np.clip(np.einsum("ij,ij->i", x, at), -MOST_LOGIT, MOST_LOGIT)
            p = 1 / (1 + np.exp(-logit))
            of = pd.MultiIndex.from_arrays([batch.column(c).to_pylist() for c in keys])
            which, names = pd.factorize(of)
            n = len(names)
            out = np.zeros((n, 3 + (k + 1) + (k + 1) ** 2))
            out[:, 0], out[:, 1] = np.bincount(which, minlength=n), np.bincount(which, (p >= 0.5) == y, n)
            out[:, 2] = np.bincount(which, np.logaddexp(0, logit) - y * logit, n)
            np.add.at(out[:, 3 : k + 4], which, x * (p - y)[:, None])
            for i in range(n):
                some = which == i
                out[i, k + 4 :] = ((x[some] * (p * (1 - p))[some, None]).T @ x[some]).ravel()
            first = [int(np.argmax(which == i)) for i in range(n)]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in keys], sums], [*keys, "sums"])

    return add


def _newton(k: int, penalty: float, tolerance: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The model's next point from the sums at its present one; both sides hold a few rows for a key."""

    def move(model: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(parts["sums"].to_list()), axis=0)
        row, n, at = model.iloc[0].copy(), total[0], np.array(model["at"].iloc[0])
        ridge = np.r_[np.full(k, 2 * penalty / k), 0.0]
        loss = total[2] / n + penalty * np.mean(at[:k] ** 2)
        if loss <= row["loss"] + 1e-13:
            slope = total[3 : k + 4] / n + ridge * at
            curve = total[k + 4 :].reshape(k + 1, k + 1) / n + np.diag(ridge + 1e-12)
            step = np.linalg.solve(curve, slope)
            row["best"], row["move"], row["loss"], row["share"], row["accuracy"] = at, step, loss, 1.0, total[1] / n
            row["done"] = bool(np.abs(slope).max() < tolerance)
            row["at"] = at - step
        else:
            row["share"] /= 2
            row["done"] = bool(row["share"] < 1e-9)
            row["at"] = np.array(row["best"]) - row["share"] * np.array(row["move"])
        return pd.DataFrame([row])

    return move


def logistic_scores(rows: DataFrame, models: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """rows with probability_up and score (-1 to 1) of their key's model; a missing feature counts as 0, rows without a model go."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    logit = sum(((v - F.get("mean", i)) / F.get("std", i) * F.get("weights", i) for i, v in enumerate(x)), F.col("bias"))
    p = sigmoid(clamp(logit, -MOST_LOGIT, MOST_LOGIT))
    out = rows.join(models.select(*keys, "mean", "std", "weights", "bias"), keys).withColumn("_p", p)
    return out.drop("mean", "std", "weights", "bias").withColumn("probability_up", F.col("_p")).withColumn("score", (F.col("_p") - 0.5) * 2).drop("_p")


def logistic_forecast(bars: DataFrame, split: Column, least: int = 80) -> DataFrame:
    """(symbol, date, part, label, probability_up, score): a model per symbol, learnt from the bars whose label was known before ``split``.

    The features' means and deviations come from the same bars; a test bar is in no statistic.
    """
    rows = return_features(bars).withColumn("part", F.when(F.col("known_at") < split, "train").otherwise("test"))
    models = fit_logistic(rows.filter("part = 'train'"), ["symbol"], list(FEATURES), "label", least=least)
    return logistic_scores(rows, models, ["symbol"], list(FEATURES)).select("symbol", "date", "part", "label", "probability_up", "score")


# --- earlier neighbours

#: Rows of a key that are compared at once.
NEIGHBOUR_BLOCK = 2048
#: The weights that calibration chooses from.
ALPHAS = (0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.2, 2.8, 3.5)


def against_earlier(rows: DataFrame, key: str, at: str, columns: list[str], answer: Callable, kind: str) -> DataFrame:
    """(key, at, *kind) of every row held against the rows of its key before it, in blocks.

    A key's rows are numbered in time and cut into blocks of NEIGHBOUR_BLOCK; a block meets itself and the blocks before
    it, each two blocks in one place, points first: a task holds one block and streams the others' rows by it.
    ``answer(asks, ask_times, points, point_times, point_dates)`` gives the places of the asks and the columns of kind.
    Rows without one of the columns ask nothing and are not looked at; rows of one time are not before each other.
    """
    names = [f"v{i}" for i in range(len(columns))]
    known = rows.select(key, F.col(at).alias("at"), *[F.col(c).cast("double").alias(v) for c, v in zip(columns, names, strict=True)]).dropna()
    numbered = known.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1) / NEIGHBOUR_BLOCK).cast("int"))
    last = numbered.groupBy(key).agg(F.max("block").alias("last"))
    points = numbered.join(last, key).select(key, F.col("block").alias("p"), F.explode(F.sequence("block", "last")).alias("q"), F.lit(0).alias("side"), "at", *names)
    asks = numbered.select(key, F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"), F.lit(1).alias("side"), "at", *names)
    both = points.union(asks).repartition(key, "p", "q").sortWithinPartitions(key, "p", "q", "side", "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            place = batch.select([key, "p", "q", "side"]).to_pandas()
            cuts = np.flatnonzero((place != place.shift()).any(axis=1))
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part = batch.slice(a, b - a)
                block = tuple(part.column(c)[0].as_py() for c in (key, "p", "q"))
                if block != now:
                    now, held = block, []
                values = np.column_stack([part.column(c).to_numpy() for c in names])
                times = part.column("at").to_numpy(zero_copy_only=False)
                if part.column("side")[0].as_py() == 0:
                    held.append((values, times, part.column("at")))
                    continue
                which, *found = answer(values, times, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held]))
                some = pa.array(which)
                out = [part.column(key).take(some), part.column("at").take(some), *[x if isinstance(x, pa.Array) else pa.array(x) for x in found]]
                yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, at)]
    return both.mapInArrow(stream, f"{key} {kinds[0]}, {at} {kinds[1]}, {kind}")


def earlier_neighbours(rows: DataFrame, key: str, at: str, vector: list[str], k: int) -> DataFrame:
    """(key, at, other_at, similarity, place): for each row its k most similar ones by cosine among those of its key strictly before it.

    Equal similarities (to 12 digits) go to the later row. Rows without a component, and zero vectors, have and are no
    neighbours. The best of each two blocks are merged.
    """

    def nearest(asks: np.ndarray, when: np.ndarray, points: np.ndarray, times: np.ndarray, dates: pa.Array) -> tuple:
        a, b = (v / np.sqrt((v**2).sum(1))[:, None] for v in (asks, points))
        close = np.where(times[None, :] < when[:, None], np.round(a @ b.T, 12), -np.inf)
        late = np.argsort(np.argsort(times, kind="stable"), kind="stable")
        order = np.lexsort((np.broadcast_to(-late, close.shape), -close), axis=1)[:, :k]
        best = np.take_along_axis(close, order, 1)
        x, y = np.nonzero(np.isfinite(best))
        return x, dates.take(pa.array(order[x, y])), best[x, y]

    some = rows.filter(sum((F.col(c).cast("double") ** 2 for c in vector), F.lit(0.0)) > 0)
    w = Window.partitionBy(key, at).orderBy(F.desc("similarity"), F.desc(f"other_{at}"))
    found = against_earlier(some, key, at, vector, nearest, f"other_{at} {rows.schema[at].dataType.simpleString()}, similarity double")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def earlier_share(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, n, share): how many values of the key came before, and the share of them that are no larger."""

    def count(asks: np.ndarray, when: np.ndarray, points: np.ndarray, times: np.ndarray, dates: pa.Array) -> tuple:
        before = times[None, :] < when[:, None]
        return np.arange(len(asks)), before.sum(1), (before & (points[:, 0] <= asks)).sum(1)

    counts = against_earlier(rows, key, at, [value], count, "n long, low long").groupBy(key, at).agg(F.sum("n").alias("n"), F.sum("low").alias("low"))
    return counts.select(key, at, "n", F.when(F.col("n") > 0, F.col("low") / F.col("n")).alias("share"))


def next_open_rows(bars: DataFrame) -> DataFrame:
    """(symbol, date, m: the last bar's return in percent, i: its mean over all symbols, label: the next open is no lower than the close, gap: days to the next bar)."""
    w = series("symbol")
    out = bars.select("symbol", "date", (pct_change("close", 1, w) * 100).alias("m"), F.when(F.lead("open").over(w).isNotNull(), (F.lead("open").over(w) >= F.col("close")).cast("int")).alias("label"), F.date_diff(F.lead("date").over(w), "date").alias("gap"))
    market = out.groupBy("date").agg(F.avg("m").alias("i"))
    return out.join(market, "date").select("symbol", "date", "m", "i", "label", "gap")


def next_open_scores(rows: DataFrame, long_gap: int = 1, k: int = 20, penalty: float = 0.7, weights: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """rows (symbol, date, m, i, label, gap) with momentum, p_up (the vote of its neighbours) and s, all from strictly earlier rows.

    momentum is the place of m among the values before it, from -1 to 1, 0 with fewer than 5; a neighbour whose next bar
    is more than ``long_gap`` days off has ``penalty`` votes instead of one.
    """
    known = rows.filter("label IS NOT NULL")
    near = earlier_neighbours(rows, "symbol", "date", ["m", "i"], k)
    votes = known.select("symbol", F.col("date").alias("other_date"), "label", F.when(F.col("gap") > long_gap, penalty).otherwise(1.0).alias("vote"))
    vote = near.join(votes, ["symbol", "other_date"]).groupBy("symbol", "date").agg((F.sum(F.col("vote") * F.col("label")) / F.sum("vote")).alias("p_up"))
    place = earlier_share(rows, "symbol", "date", "m").filter("n >= 5").select("symbol", "date", clamp((F.col("share") * 100 - 50) / 50, -1.0, 1.0).alias("momentum"))
    out = rows.join(place, ["symbol", "date"], "left").join(vote, ["symbol", "date"], "left")
    out = out.withColumn("momentum", F.coalesce("momentum", F.lit(0.0)))
    return out.withColumn("s", weights[0] * F.col("momentum") + weights[1] * F.coalesce(2 * F.col("p_up") - 1, F.lit(0.0)))


def calibrated(scored: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """scored (symbol, date, s, label) with alpha, p_up_rule and the brier of its choice: of ALPHAS the one that had the least Brier score over
    the last ``window`` labelled rows before; 1 with fewer than ``least`` of them. The whole grid is one window plan."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-window, -1)
    miss = [F.when(F.col("label").isNotNull(), (sigmoid(F.lit(a) * F.col("s")) - F.col("label")) ** 2) for a in ALPHAS]
    out = scored.withColumns({f"_b{j}": m for j, m in enumerate(miss)})
    out = out.withColumn("_n", F.count("_b0").over(w)).withColumn("_all", F.array(*[F.struct(F.round(F.avg(f"_b{j}").over(w), 12).alias("b"), F.lit(j).alias("j")) for j in range(len(ALPHAS))]))
    best = F.array_min("_all")
    enough = F.col("_n") >= least
    alpha = F.when(enough, F.get(F.array(*[F.lit(a) for a in ALPHAS]), best["j"])).otherwise(1.0)
    out = out.withColumn("alpha", alpha).withColumn("brier", F.when(enough, best["b"]))
    return out.withColumn("p_up_rule", sigmoid(F.col("alpha") * F.col("s"))).drop("_n", "_all", *[f"_b{j}" for j in range(len(ALPHAS))])


# --- descent for the time-series models


def minimise(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, float, bool, int]:
    """(point, value, converged, steps taken) of quasi-Newton descent; f takes a batch of points, so that a gradient or a line search is one call."""
    n, width = len(start), 1e-5
    x, inverse = start.astype(float), np.eye(len(start))

    def gradient(at: np.ndarray) -> np.ndarray:
        shifts = np.vstack([np.eye(n), -np.eye(n)]) * width
        v = f(at + shifts)
        return (v[:n] - v[n:]) / (2 * width)

    value, g = float(f(x[None])[0]), gradient(x)
    for step in range(steps):
        if np.abs(g).max() < tolerance:
            return x, value, True, step
        move = -inverse @ g
        if move @ g >= 0:
            inverse, move = np.eye(n), -g
        shares = 0.5 ** np.arange(12) * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        tried = f(x + shares[:, None] * move)
        good = np.flatnonzero(tried <= value + 1e-4 * shares * (move @ g))
        if not len(good):
            flat = np.abs(g).max() < 100 * tolerance
            if flat or np.allclose(inverse, np.eye(n)):
                return x, value, bool(flat), step
            inverse = np.eye(n)
            continue
        best = good[0]
        new, new_value = x + shares[best] * move, float(tried[best])
        new_g = gradient(new)
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            rho, eye = 1 / (s @ y), np.eye(n)
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, value, g = new, new_value, new_g
    return x, value, bool(np.abs(g).max() < tolerance), steps


# --- GARCH


def garch_parameters(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mu, omega, alpha, beta) of free points (rows of four): omega is positive, alpha + beta below 1."""
    a, b = np.exp(np.clip(z[:, 2], -30, 30)), np.exp(np.clip(z[:, 3], -30, 30))
    return z[:, 0], np.exp(np.clip(z[:, 1], -30, 30)), a / (1 + a + b), b / (1 + a + b)


def garch_loss(r: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Half the mean of log v + e^2 / v over the series, for each point; v starts at the variance of the series."""
    mu, omega, alpha, beta = garch_parameters(z)
    e2 = (r[:, None] - mu) ** 2
    v, out = np.full(len(mu), r.var()), np.zeros(len(mu))
    for t in range(len(r)):
        if t:
            v = omega + alpha * e2[t - 1] + beta * v
        out += np.log(v) + e2[t] / v
    return out / (2 * len(r))


def fit_garch(r: np.ndarray, steps: int = 100) -> dict[str, float | int | bool]:
    """GARCH(1, 1) with a constant mean by maximum likelihood; r is scaled to unit variance for the descent and back after it."""
    scale = float(r.std())
    if not scale > 0:
        return {"mu": float(r.mean()), "omega": 0.0, "alpha": 0.0, "beta": 0.0, "loglik": math.nan, "sigma_next": 0.0, "converged": False, "steps": 0}
    x = r / scale
    starts = [np.array([x.mean(), math.log(0.05), math.log(a / (1 - a - b)), math.log(b / (1 - a - b))]) for a, b in ((0.05, 0.9), (0.1, 0.8), (0.2, 0.5))]
    start = starts[int(np.argmin(garch_loss(x, np.array(starts))))]
    z, value, converged, taken = minimise(lambda p: garch_loss(x, p), start, steps, 1e-6)
    mu, omega, alpha, beta = (float(v[0]) for v in garch_parameters(z[None]))
    v = x.var()
    for t in range(1, len(x) + 1):
        v = omega + alpha * (x[t - 1] - mu) ** 2 + beta * v
    loglik = -len(r) * (value + 0.5 * math.log(2 * math.pi) + math.log(scale))
    return {"mu": mu * scale, "omega": omega * scale**2, "alpha": alpha, "beta": beta, "loglik": loglik, "sigma_next": math.sqrt(v) * scale, "converged": converged, "steps": taken}


def garch_forecast(bars: DataFrame, window: int = 500, least: int = 60, z: float = 1.645, share: float = 1.0) -> DataFrame:
    """Per symbol at its last bar: the fitted GARCH(1, 1) of its last ``window`` log returns (times 1000), and the range z * sigma * sqrt(share) around the close.

    A series is one row with an array of at most ``window`` returns, so that no task holds more than a batch of them.
    ``converged`` is false where the descent ran out of steps; symbols with fewer than ``least`` returns, and constant
    ones, give no fit. The lower end is not below 0.8 of the close.
    """
    w = series("symbol")
    out = bars.select("symbol", "date", "close", F.when(F.lag("close").over(w) > 0, F.log(F.col("close") / F.lag("close").over(w)) * 1000).alias("r"))
    out = tail(out.filter("r IS NOT NULL"), ["symbol"], "date", window)
    ordered = F.sort_array(F.collect_list(F.struct("date", "r", "close")))
    rows = out.groupBy("symbol").agg(ordered.alias("x")).filter(F.size("x") >= least)
    rows = rows.select("symbol", F.element_at("x", -1)["date"].alias("date"), F.element_at("x", -1)["close"].alias("close"), F.col("x.r").alias("r")).repartition("symbol")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [fit_garch(np.array(r.as_py())) for r in batch.column("r")]
            made = {k: pa.array([f[k] for f in fits], pa.bool_() if k == "converged" else pa.int32() if k == "steps" else pa.float64()) for k in ("mu", "omega", "alpha", "beta", "loglik", "sigma_next", "converged", "steps")}
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), batch.column("date"), batch.column("close"), pa.array([len(r) for r in batch.column("r")], pa.int32()), *made.values()], ["symbol", "date", "close", "n", *made])

    kinds = bars.schema
    kind = f"symbol {kinds['symbol'].dataType.simpleString()}, date {kinds['date'].dataType.simpleString()}, close double, n int, mu double, omega double, alpha double, beta double, loglik double, sigma_next double, converged boolean, steps int"
    got = rows.withColumn("close", F.col("close").cast("double")).mapInArrow(fit, kind).filter("sigma_next > 0")
    move = z * F.col("sigma_next") / 1000 * math.sqrt(share)
    got = got.withColumns({"aic": 8 - 2 * F.col("loglik"), "bic": 4 * F.log("n") - 2 * F.col("loglik")})
    return got.withColumns({"lower": F.greatest(F.col("close") * (1 - move), F.col("close") * 0.8), "upper": F.col("close") * (1 + move)})


# --- ARIMA

#: The orders (p, q) that are tried, on once-differenced prices.
ORDERS = ((1, 1), (2, 1), (1, 2), (2, 2), (1, 0), (0, 1), (0, 2), (2, 0), (3, 1), (1, 3), (3, 2), (2, 3))


def lag_weights(free: np.ndarray) -> np.ndarray:
    """Rows of free numbers as weights of a stationary autoregression: partial autocorrelations by tanh, then the Levinson recursion."""
    partial = np.tanh(free)
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        was = out[:, :k].copy()
        out[:, k] = partial[:, k]
        out[:, :k] = was - partial[:, k : k + 1] * was[:, ::-1]
    return out


def arma_residuals(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The innovations of d for each row of weights; what lies before the series counts as 0."""
    p, q = phi.shape[1], theta.shape[1]
    padded = np.r_[np.zeros(p), d]
    e = np.repeat(d[:, None], len(phi), 1)
    for i in range(p):
        e -= phi[:, i] * padded[p - 1 - i : p - 1 - i + len(d), None]
    for t in range(1, len(d) if q else 0):
        for j in range(min(q, t)):
            e[t] -= theta[:, j] * e[t - 1 - j]
    return e


def fit_arima(prices: np.ndarray, p: int, q: int, ahead: int = 3, steps: int = 60) -> dict[str, float | bool]:
    """ARIMA(p, 1, q) without a constant by conditional likelihood: aic, bic, mean p-value, Ljung-Box p-value, residual variance, mean forecast."""
    d = np.diff(prices)
    n, scale = len(d), float(np.sqrt(np.mean(d**2)))
    if not scale > 0:
        return {"aic": math.nan, "bic": math.nan, "mean_p": math.nan, "ljung_box": math.nan, "variance": 0.0, "forecast": float(prices[-1]), "converged": False}
    x = d / scale

    def split(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lag_weights(z[:, :p]), -lag_weights(z[:, p:])

    def loss(z: np.ndarray) -> np.ndarray:
        return 0.5 * np.log(np.mean(arma_residuals(x, *split(z)) ** 2, axis=0))

    z, value, converged, _ = minimise(loss, np.full(p + q, 0.05), steps, 1e-5)
    phi, theta = (v[0] for v in split(z[None]))
    e = arma_residuals(d, phi[None], theta[None])[:, 0]
    s2 = float(np.mean(e**2))
    loglik = -n / 2 * (math.log(2 * math.pi * s2) + 1)
    at = np.r_[phi, theta]
    errors = _errors(x, at, p, float(np.mean((e / scale) ** 2)))
    each = [math.erfc(abs(v / s) / math.sqrt(2)) if s > 0 else 1.0 for v, s in zip(at, errors, strict=True)]
    each.append(math.erfc(math.sqrt(n / 2) / math.sqrt(2)))  # of the variance, whose standard error is s2 * sqrt(2 / n)
    history, shocks, out = list(d), list(e), []
    for _ in range(ahead):
        step = sum(phi[i] * history[-1 - i] for i in range(p)) + sum(theta[j] * shocks[-1 - j] for j in range(q))
        history.append(step)
        shocks.append(0.0)
        out.append(step)
    forecast = float(np.mean(prices[-1] + np.cumsum(out)))
    k = p + q + 1
    return {"aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik, "mean_p": float(np.mean(each)), "ljung_box": ljung_box(e), "variance": float(np.var(e)), "forecast": forecast, "converged": converged}


def _errors(x: np.ndarray, at: np.ndarray, p: int, s2: float) -> np.ndarray:
    """Standard errors of the weights, from the slopes of the innovations."""
    width, n = 1e-5, len(at)
    points = np.vstack([at + np.eye(n) * width, at - np.eye(n) * width])
    e = arma_residuals(x, points[:, :p], points[:, p:])
    slope = (e[:, :n] - e[:, n:]) / (2 * width)
    return np.sqrt(np.maximum(np.diag(np.linalg.pinv(slope.T @ slope)) * s2, 0))


def ljung_box(e: np.ndarray, lags: int = 10) -> float:
    """The p-value of the Ljung-Box test on ``lags`` (even) autocorrelations of the residuals; NaN with 10 values or fewer."""
    n = len(e)
    lags = min(lags, n // 4 * 2)
    if n <= 10:
        return math.nan
    c = e - e.mean()
    total = float(c @ c)
    stat = n * (n + 2) * sum((float(c[k:] @ c[:-k]) / total) ** 2 / (n - k) for k in range(1, lags + 1)) if total > 0 else 0.0
    term, out = math.exp(-stat / 2), 0.0  # the chi-square tail in closed form for an even number of degrees
    for j in range(lags // 2):
        out += term
        term *= stat / 2 / (j + 1)
    return out


def arima_fits(bars: DataFrame, window: int = 200, least: int = 30) -> DataFrame:
    """(symbol, p, q, n, close, aic, bic, mean_p, ljung_box, variance, forecast, converged): every order of ORDERS on each symbol's last ``window`` closes.

    A row is a series and an order; Spark deals the fits out, so that a symbol's orders are fitted beside each other.
    """
    out = tail(bars.select("symbol", "date", F.col("close").cast("double").alias("close")).filter("close IS NOT NULL"), ["symbol"], "date", window)
    rows = out.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("x")).filter(F.size("x") >= least)
    orders = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in ORDERS])
    rows = rows.select("symbol", F.col("x.close").alias("x"), F.explode(orders).alias("o")).select("symbol", "o.p", "o.q", "x").repartition("symbol", "p", "q")
    names = ("aic", "bic", "mean_p", "ljung_box", "variance", "forecast", "converged")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series_ = [np.array(x.as_py()) for x in batch.column("x")]
            fits = [fit_arima(x, p, q) for x, p, q in zip(series_, batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)]
            made = [pa.array([f[k] for f in fits], pa.bool_() if k == "converged" else pa.float64()) for k in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in series_], pa.int32()), pa.array([x[-1] for x in series_], pa.float64()), *made], ["symbol", "p", "q", "n", "close", *names])

    kind = f"symbol {bars.schema['symbol'].dataType.simpleString()}, p int, q int, n int, close double, " + ", ".join(f"{k} {'boolean' if k == 'converged' else 'double'}" for k in names)
    return rows.mapInArrow(fit, kind)


def arima_trend(bars: DataFrame, window: int = 200, least: int = 30) -> DataFrame:
    """(symbol, p, q, aic, bic, forecast, change, atr, threshold, direction, strength, confidence) of each symbol's best order by AIC.

    direction is up or down where the mean forecast leaves the close by more than the threshold, which the mean true range
    of 20 bars sets, else flat. confidence is the mean of four: the weights' p-values, AIC and BIC, Ljung-Box, residual variance.
    """
    fits = arima_fits(bars, window, least)
    order = F.array_position(F.array(*[F.lit(10 * p + q) for p, q in ORDERS]), 10 * F.col("p") + F.col("q"))
    best = fits.filter(~F.isnan("aic")).groupBy("symbol").agg(F.min(F.struct(F.round("aic", 9).alias("a"), order.alias("o"), *[c for c in fits.columns if c != "symbol"])).alias("x")).select("symbol", "x.*").drop("a", "o")
    w = series("symbol")
    was = F.lag("close").over(w)
    ranges = bars.select("symbol", "date", "close", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was)).alias("tr"), was.isNotNull().alias("moved"))
    last = tail(ranges.filter("moved"), ["symbol"], "date", 20).groupBy("symbol").agg(F.when(F.count("tr") == 20, clamp(F.avg("tr") / F.max_by("close", "date") * 100, 0.5, 3.0)).otherwise(1.0).alias("atr"))
    out = best.join(last, "symbol", "left").withColumn("atr", F.coalesce("atr", F.lit(1.0)))
    out = out.withColumn("threshold", F.when(F.col("atr") < 1, 0.5).when(F.col("atr") > 2, 1.5).otherwise(1.0)).withColumn("change", (F.col("forecast") - F.col("close")) / F.col("close") * 100)
    size = F.abs("change") / F.col("threshold")
    direction = F.when(F.col("change") > F.col("threshold"), "up").when(F.col("change") < -F.col("threshold"), "down").otherwise("flat")
    strength = F.when(direction == "flat", F.greatest(F.lit(0.2), 0.5 - size / 2)).otherwise(F.least(F.lit(1.0), size / 3))
    held = lambda c: F.coalesce(clamp(F.when(~F.isnan(c), c), 0.5, 0.95), F.lit(0.7))
    parts = [held(1 - 2 * F.col("mean_p")), (held(1 - F.col("aic") / 10000) + held(1 - F.col("bic") / 10000)) / 2, held(F.col("ljung_box")), held(1 - F.col("variance") / 10000)]
    return out.select("symbol", "p", "q", "n", "close", "aic", "bic", "forecast", "change", "atr", "threshold", direction.alias("direction"), strength.alias("strength"), clamp(sum(parts, F.lit(0.0)) / 4, 0.5, 0.95).alias("confidence"), "converged")
