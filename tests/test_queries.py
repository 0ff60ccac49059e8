"""Every registered market query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(frame):
    """Columns by name, numbers as doubles, all else as text; rows in one order."""
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind in "iufb":
            out[c] = out[c].astype(float)
        elif out[c].dtype.kind == "M" or len(out) and hasattr(out[c].iloc[0], "isoformat"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        else:
            out[c] = out[c].astype(str)
    keys = {c: out[c].round(4) if out[c].dtype.kind == "f" else out[c] for c in out.columns}
    order = out.assign(**keys).sort_values(list(out.columns)).index
    return out.loc[order].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(catalog.queries()[name](spark, SF).toPandas()), plain(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], rtol=1e-7, atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_running_product_keeps_signs_and_zeros(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.windows import running_product, series

    rows = [("a", 1, 2.0), ("a", 2, -3.0), ("a", 3, None), ("a", 4, -0.5), ("a", 5, 0.0), ("a", 6, 4.0), ("b", 1, None), ("b", 2, 1.5)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double")
    got = df.select("symbol", "date", running_product(F.col("x"), series("symbol")).alias("p")).orderBy("symbol", "date").collect()
    want = [2.0, -6.0, -6.0, 3.0, 0.0, 0.0]
    assert all(math.isclose(r.p, w, abs_tol=1e-12) for r, w in zip(got[:6], want, strict=True))
    assert math.isclose(got[7].p, 1.5)


def test_nearest_neighbours_match_brute_force(spark, duck, monkeypatch):
    from tidemark.operators import screening

    monkeypatch.setattr(screening, "QUERY_BLOCK", 10)
    monkeypatch.setattr(screening, "POINT_BLOCK", 90)
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = {}
    for k in np.flatnonzero(ids % 20 == 0):
        d = 1 - v @ v[k]
        near = [j for j in np.lexsort((ids, d)) if j != k][:5]
        want |= {(ids[k], place): (ids[j], round(d[j], 6)) for place, j in enumerate(near, 1)}
    got = {(r["query"], r.place): (r.id, r.distance) for r in catalog.queries()["c10_nearest_neighbours"](spark, SF).collect()}
    assert set(got) == set(want) and len(want) == 5 * (ids % 20 == 0).sum()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in want)


def test_nearest_neighbours_tie_by_id(spark):
    from tidemark.operators import screening

    rows = [(i, [0.1, 0.7, 0.3]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    got = screening.nearest_neighbours(points, points.selectExpr("id AS query", "v AS q").filter("query IN (3, 90, 91)"), 3).collect()
    assert sorted((r["query"], r.place, r.id) for r in got) == [(3, 1, 0), (3, 2, 1), (3, 3, 2)]


def test_cooldown_streams_each_rule(spark):
    import random

    from tidemark.operators import screening

    rng = random.Random(2)
    rows = [(rule, k, None if k % 50 == 49 else rng.choice([rng.randrange(4000), 10_000 + rng.randrange(300), 9_000_000])) for rule in (1, 2, None) for k in range(400)]
    df = spark.createDataFrame(rows, "rule int, event_id long, s long").selectExpr("rule", "event_id", "timestamp_seconds(s) AS ts")
    made = screening.cooled(df, ["rule"], "ts", 60)
    want, last = {}, {}
    for rule, k, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[2], r[1])):
        fires = rule not in last or s - last[rule] >= 60
        last[rule] = s if fires else last[rule]
        want[rule, k] = "triggered" if fires else "cooldown_skipped"
    want |= {(rule, k): "cooldown_skipped" for rule, k, s in rows if s is None}
    assert {(r.rule, r.event_id): r.status for r in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_and_terciles_rank_values_not_rows(spark):
    """Ties cut by a third against plain sorting; a hot value is one row of the window."""
    import random

    from tidemark.operators import evaluation

    rng = random.Random(5)
    rows = [(g, k, rng.randrange(m), float(rng.randrange(100)) if k % 7 else None) for g, n, m in (("a", 200, 4), ("b", 2, 1), ("c", 31, 31), ("d", 90, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, score int, y double")
    made = evaluation.tercile_spread(df, ["g"], "score", "y", "id")
    mean = lambda ys: sum(y for y in ys if y is not None) / max(1, sum(y is not None for y in ys))
    for r in made.collect():
        ys = [x[3] for x in sorted((x for x in rows if x[0] == r.g), key=lambda x: (-x[2], x[1]))]
        n = max(1, len(ys) // 3)
        assert math.isclose(r.bottom, mean(ys[-n:])) and (r.top is None if set(ys[:n]) == {None} else math.isclose(r.top, mean(ys[:n])))
    quantile = evaluation.weighted_quantile(df, ["g"], "score", "id", 0.8)
    for made in (made, quantile):
        plan = made._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
        assert "Aggregate" in plan


def test_uploads_in_several_files_are_the_same_uploads(spark, duck, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import stores

    monkeypatch.setattr(stores, "UPLOAD_ROWS", 20)
    folder = stores._uploaded(spark, SF).groupBy("folder").agg(F.count_distinct("file").alias("n"))
    assert folder.count() == 24 and folder.filter("n < 3").count() == 0
    for name in ("a25_uploaded_bars", "a25_rejects"):
        got, want = plain(catalog.queries()[name](spark, SF).toPandas()), plain(duck.execute(catalog.oracle_sql()[name]).df())
        assert got.equals(want[got.columns].astype(got.dtypes)) and len(got) > 7


def test_events_of_one_time_are_all_appended(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0]
    events.union(events.withColumn("event_id", F.col("event_id") + last + 1)).write.parquet(f"{tmp_path}/events.parquet")
    out = catalog.queries()["a12_append_unseen"](spark, str(tmp_path))
    assert out.count() == out.select("event_id").distinct().count() == 2 * events.count()
