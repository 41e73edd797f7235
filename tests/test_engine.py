"""Kernels against hand cases, operators against numpy, and native queries against DuckDB on the smallest tables."""

import datetime
import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.config import STATE
from lattica.functions import kernels, register
from lattica.operators import attention, coupling, evaluate, events, fits, hazard, network, series, state, studies, windows
from lattica.plans import evaluation
from lattica.plans import every as catalog
from lattica.sources import formats, panels

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def frame(spark, values, uid="u", name="x"):
    return spark.createDataFrame([(uid, day(k), None if v is None else float(v)) for k, v in enumerate(values)], f"uid string, t date, {name} double")


def by_date(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["t"])]


# Kernels


def test_square_and_hexagon_have_one_cycle():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    d = np.linalg.norm(square[:, None] - square[None], axis=2)
    zero, one = kernels.barcodes(d)
    assert zero[:, 1].tolist() == [1, 1, 1] and np.allclose(one, [[1, np.sqrt(2)]])
    angle = np.arange(6) * np.pi / 3
    hexagon = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    _, one = kernels.barcodes(np.linalg.norm(hexagon[:, None] - hexagon[None], axis=2))
    assert np.allclose(one, [[1, np.sqrt(3)]])
    triangle = 1 - np.eye(3)
    assert len(kernels.barcodes(triangle)[1]) == 0


def test_spectrum_of_equal_correlations():
    n, rho = 6, 0.4
    values = kernels.spectrum(np.full((n, n), rho) + (1 - rho) * np.eye(n))
    assert values[0] == pytest.approx(1 + (n - 1) * rho) and np.allclose(values[1:], 1 - rho)


def test_ranks_and_constant_columns():
    assert kernels.average_ranks(np.array([3.0, 1, 3, 2]))[:, 0].tolist() == [3.5, 1, 3.5, 2]
    x = np.random.default_rng(0).normal(size=(22, 5))
    x[:, 2] = 7
    c = kernels.spearman(x)
    assert np.allclose(np.diag(c), 1) and np.allclose(c[2, [0, 1, 3, 4]], 0)


def test_assignment_is_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in range(1, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert cost[np.arange(n), kernels.assignment(cost)].sum() == pytest.approx(best)
    a = np.array([[0.0, 2.0]])
    assert kernels.wasserstein(a, np.zeros((0, 2))) == 1.0 and kernels.wasserstein(a, a) == 0.0


def test_recurrence_lines():
    assert kernels._lines(np.array([1, 1, 0, 1, 0, 1, 1, 1], bool)).tolist() == [2, 1, 3]
    found = kernels.recurrence(kernels.embedded(np.sin(np.arange(60) / 4), 6))
    assert 0 < found["rr"] < 1 and 0.5 < found["det"] <= 1


def test_a_ring_of_pixels_has_one_loop():
    height = np.full((5, 5), 2.0)
    height[1:4, 1:4] = 0.0
    height[2, 2] = 1.0
    assert kernels.cubical_loops(height) == [1.0] and kernels.cubical_loops(np.zeros((4, 4))) == []


def brute_lag(x, most=20):
    for lag in range(1, min(most, len(x) // 2)):
        a, b = x[: len(x) - lag], x[lag:]
        if a.std() > 0 and b.std() > 0 and np.cov(a, b)[0, 1] <= 0:
            return lag
    return min(most, max(1, len(x) // 4))


def test_delay_is_the_first_lag_apart():
    rng = np.random.default_rng(11)
    for n in (1, 2, 5, 9, 30, 120):
        for _ in range(20):
            x = np.cumsum(rng.normal(size=n)) if n % 2 else np.sin(np.arange(n) / rng.uniform(0.5, 9))
            assert kernels.delay(x) == brute_lag(x)
    assert kernels.delay(np.ones(40)) == 10 and kernels.delay(np.ones(40), strict=True, otherwise=1) == 1


def test_fit_is_stationary():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(float)
    w = kernels.logistic_fit(x, y)
    gradient = np.column_stack([np.ones(300), x]).T @ (kernels.logistic_scores(w, x) - y) + np.r_[0, w[1:]]
    assert np.abs(gradient).max() < 1e-6


def test_auc_counts_pairs():
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 5, 60).astype(float), rng.integers(0, 2, 60)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert kernels.auc(s, y) == pytest.approx(np.mean(pairs)) and kernels.auc(s, y) + kernels.auc(-s, y) == pytest.approx(1)


def test_engagement_windows_drop_constant_channels():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10, 4))
    x[:, 1] = 3.0
    found, own = windows.engagement_state(x), kernels.spectral_five(kernels.shrunk(kernels.spearman(x[:, [0, 2, 3]]), 0.1))
    assert found["active"] == 3 and found["oh"] == own["oh"]
    assert windows.engagement_state(np.ones((10, 4)))["oh"] == 0.0


# Series


def test_crossings(spark):
    s = frame(spark, [0.5, 0.5, 1.5, 1.5, 1.5, 0.5])
    assert series.first_crossing(s, "x", 1.0, 3).first()["crossing"] == day(2)
    assert series.first_crossing(frame(spark, [0.5, 1.5, 0.5, 1.5, 0.5]), "x", 1.0, 3).first()["crossing"] is None


def test_memory_rises_in_a_crisis_and_decays_to_its_floor(spark):
    drive = frame(spark, [0] * 5 + [2.5] * 10 + [0] * 900)
    out = by_date(series.folded(drive, ["x"], ["m"], lambda d: [series.leaky_memory(d, 0.97, 1e-6)]), "m")
    assert out[14] > out[4] and out[-1] == 1e-6 and min(out) == 1e-6 and all(a >= b for a, b in zip(out[14:], out[15:]))


def test_runs_and_gaps(spark):
    found = series.runs(frame(spark, [1, 1, 0, 0, 0, 1]), F.col("x") > 0).orderBy("start").collect()
    assert [(r["flag"], r["length"]) for r in found] == [(True, 2), (False, 3), (True, 1)]


def test_activation_kinds(spark):
    shapes = {
        "none": np.zeros(50),
        "ramp": np.concatenate([np.zeros(100), np.linspace(0, 1, 30), np.ones(60)]),
        "spike": np.concatenate([np.zeros(100), np.ones(6), np.zeros(60)]),
        "building": np.concatenate([np.zeros(80), np.ones(12), np.full(40, 0.3)]),
        "again": np.concatenate([np.zeros(70), np.ones(6), np.zeros(50), np.ones(35)]),
        "on": np.ones(8),
    }
    rows = [(uid, day(k), float(v)) for uid, x in shapes.items() for k, v in enumerate(x)]
    found = {r["uid"]: r for r in series.activations(spark.createDataFrame(rows, "uid string, t date, x double")).collect()}
    assert {u: r["kind"] for u, r in found.items()} == {"none": "NONE", "ramp": "RAMP", "spike": "SPIKE", "building": "BUILDING", "again": "RAMP", "on": "BUILDING"}
    assert found["none"]["start"] == -1 and found["spike"]["start"] == 100 and found["ramp"]["start"] == 115
    # before the ramp's start, the rows that rise: those of the slope, and the last flat one
    assert found["ramp"]["growth"] == 15 + 1 - 1 and found["spike"]["growth"] == 1 and found["on"]["growth"] == 0
    assert (found["again"]["start"], found["again"]["effective_start"], found["again"]["persistence"], found["again"]["duration"]) == (70, 126, 35, 35)
    assert (found["spike"]["persistence"], found["spike"]["duration"], found["building"]["duration"]) == (6, 6, 52)


def test_recurrence_windows_equal_the_kernel(spark):
    rng = np.random.default_rng(12)
    x = {"a": np.cumsum(rng.normal(size=230)), "b": np.sin(np.arange(170) / 5) + 0.2 * rng.normal(size=170), "short": rng.normal(size=40)}
    rows = spark.createDataFrame([(u, day(k), float(v)) for u, own in x.items() for k, v in enumerate(own)], "uid string, t date, x double")
    assert {r["uid"]: r["lag"] for r in windows.lags(rows).collect()} == {u: brute_lag(own) for u, own in x.items()}
    found = {(r["uid"], (r["t"] - DAY).days): r for r in windows.recurrence_series(rows).collect()}
    assert len(found) == sum(map(len, x.values()))
    for u, own in x.items():
        rates = np.full((len(own), 4), np.nan)
        for k in range(60, len(own)):
            rates[k] = list(kernels.recurrence(kernels.embedded(own[k - 60 : k], brute_lag(own))).values())
        score = np.zeros(len(own))
        for weight, c in ((0.40, 1), (0.35, 2), (0.25, 3)):
            calm = rates[: int(0.4 * len(own)), c]
            calm = calm[np.isfinite(calm)]
            if len(calm) > 5:
                score += weight * np.maximum(np.nan_to_num((rates[:, c] - calm.mean()) / max(calm.std(), 0.01)), 0)
        for k in range(len(own)):
            r = found[u, k]
            assert (r["det"] is None) == (k < 60) and (k < 60 or r["det"] == pytest.approx(rates[k, 1]))
            if r["geometry"] == "HIGH":
                assert r["theta"] == pytest.approx(min(score[k], 5.0), abs=1e-9)
    assert {r["geometry"] for (u, _), r in found.items() if u == "short"} == {"NOT_APPLIED"}
    long = rows.select("uid", F.lit("x").alias("observable"), "t", "x").unionByName(rows.select("uid", F.lit("flat").alias("observable"), "t", F.lit(1.0).alias("x")))
    spot = {(r["uid"], r["observable"]): r for r in windows.spot_check(long).collect()}
    assert spot["a", "flat"]["geometry"] == "N/A" and spot["short", "x"]["geometry"] == "N/A" and spot["a", "x"]["theta"] >= 0


def test_models_by_sums_equal_the_kernel(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 3)) * [1, 20, 0.01] + [0, 5, 3]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5)))).astype(int)
    rows = spark.createDataFrame([(k, *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))], "row long, a double, b double, c double, y int").repartition(5)
    scaled = lambda z: (z - z.mean(0)) / z.std(0)
    fold = lambda batch: np.column_stack([np.ones(batch.num_rows), batch.column("row").to_numpy() % 3 > 0]).astype(float)
    weights, plain = fits.logistic_models(rows, ["a", "b", "c"], 2, fold)
    assert np.allclose(weights[0], kernels.logistic_fit(scaled(x), y.astype(float)), atol=1e-6)
    some = np.arange(300) % 3 > 0
    assert np.allclose(weights[1], kernels.logistic_fit(scaled(x[some]), y[some].astype(float)), atol=1e-6)
    own = fits.scores(rows, ["a", "b", "c"], plain, lambda batch: fold(batch) * 0 + [1, 0], ["row"]).collect()
    expected = kernels.logistic_scores(weights[0], scaled(x))
    assert len(own) == 300 and all(r["score"] == pytest.approx(expected[r["row"]], abs=1e-9) for r in own)
    masked, _ = fits.logistic_models(rows, ["a", "b", "c"], 1, lambda batch: np.ones((batch.num_rows, 1)), masks=np.array([[True, False, True]]))
    assert np.allclose(masked[0, [0, 1, 3]], kernels.logistic_fit(scaled(x[:, [0, 2]]), y.astype(float)), atol=1e-6) and masked[0, 2] == 0
    draws = fits.resampled(np.arange(20_000), np.arange(3))
    assert np.allclose([draws.mean(), draws.var()], 1, atol=0.03)


def test_growing_graph_is_a_tree(spark):
    edges = studies.growing_graph(spark, 200)
    found = edges.collect()
    assert len(found) == 199 and {r["v"] for r in found} == set(range(1, 200)) and all(r["u"] < r["v"] for r in found)
    assert network.components(edges).where("component <> 0").count() == 0


def test_cycle_ratio_and_viscosity(spark):
    rows = [("u", day(k), k % 3 if k < 20 else 6, "rigid" if 30 <= k < 36 else "flow", 2.0) for k in range(50)]
    full = studies.cycle_ratio(series.numbered(spark.createDataFrame(rows, "uid string, t date, h1_count int, regime string, eta double")))
    calm = np.array([k % 3 for k in range(20)], float)
    xi = np.array([r[2] for r in rows]) / max(np.quantile(calm, 0.95), 1)
    assert by_date(full, "xi") == pytest.approx(xi.tolist()) and full.first()["xi_c"] == pytest.approx(max(np.quantile(xi[:20], 0.99), xi[:20].max()) * 1.02)
    assert studies.viscosity(full).first()["viscosity"] == pytest.approx(6 * 2.0 / (xi[30:36].mean() + np.quantile(xi[xi > 0], 0.05)))


def test_cleaning(spark):
    rows = [("u", day(k), "a", 1.0 + k) for k in range(20)] + [("u", day(k), "b", 2.0) for k in range(20) if not 5 <= k <= 12] + [("u", day(k), "late", 3.0) for k in range(15, 20)]
    panel = spark.createDataFrame(rows, "uid string, t date, asset string, x double")
    clean = panels.trimmed(panel, 2).collect()
    assert {r["asset"] for r in clean} == {"a", "b"}
    assert day(10) not in {r["t"] for r in clean} or day(9) in {r["t"] for r in clean}
    assert len({r["t"] for r in clean}) == 17  # of eight missing days, five are filled


def test_run_complexity_counts_runs(spark):
    bits = spark.createDataFrame([("u", day(t), f"a{k}", "b", t + 1, int(c)) for t, s in enumerate(["01", "10", "00", "10"]) for k, c in enumerate(s)], "uid string, t date, a string, b string, i int, bit int")
    found = by_date(coupling.run_complexity(bits), "complexity")
    text = "01100010"
    changes = 1 + sum(a != b for a, b in zip(text, text[1:]))
    assert found[:2] == [1.0, 1.0] and found[3] == pytest.approx(changes / (8 / np.log2(9)), abs=1e-6)


def test_rolling_correlations_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    x[5:30, 1] = 1.0  # constant windows
    rows = spark.createDataFrame([("u", day(t), f"a{k}", float(x[t, k])) for t in range(40) for k in range(4)], "uid string, t date, asset string, r double")
    for got, kernel in ((coupling.rolling_pearson(rows, 10), kernels.correlation), (coupling.rolling_spearman(rows, 10), kernels.spearman)):
        for r in got.collect():
            end = (r["t"] - DAY).days
            c = kernel(x[end - 9 : end + 1])
            assert r["c"] == pytest.approx(c[int(r["a"][1]), int(r["b"][1])], abs=1e-8)


def test_window_kernels_meet_native_state(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 5))
    rows = spark.createDataFrame([("u", day(t), f"a{k}", float(x[t, k])) for t in range(150) for k in range(5)], "uid string, t date, asset string, r double")
    full = {r["t"]: r for r in windows.by_window(rows, 22, windows.full_state, windows.STATE_COLUMNS).collect()}
    assert len(full) == 150 - 21
    some = {r["t"]: r for r in state.window_state(rows).collect()}
    assert set(some) == set(full)
    one = windows.full_state(x[100 - 21 : 101])
    assert full[day(100)]["curvature"] == one["curvature"] and full[day(100)]["mean_corr"] == pytest.approx(one["mean_corr"])


def test_complete_graph_curvature(spark):
    edges = spark.createDataFrame([("g", a, b) for a in range(4) for b in range(a + 1, 4)], "g string, u int, v int")
    assert {r["curvature"] for r in network.forman_ricci(edges, ["g"]).collect()} == {4.0}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 9), (9, 12), (12, 13)], "u long, v long")
    assert dict((r["id"], r["component"]) for r in network.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 5, 12: 5, 13: 5}


def test_attention_extremes(spark):
    found = {r["g"]: r for r in attention.entropy_family(attention.synthetic_attention(spark, 8)).collect()}
    assert found["uniform"]["omega"] == 1.0 and found["uniform"]["gini"] == 0.0 and found["diagonal"]["omega"] == pytest.approx(0.5)


def test_ranked_scores(spark):
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 6, 80) / 5, rng.integers(0, 2, 80)
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, y)], "g string, score double, y int")
    assert evaluate.rank_auc(rows).first()["auc"] == pytest.approx(kernels.auc(s, y), abs=1e-6)
    assert evaluate.rank_auc(rows.where("y = 1")).first()["auc"] is None


def test_hazard_functions(spark):
    row = spark.range(1).select(hazard.collapse_probability(F.lit(0.5), 1).alias("p"), hazard.half_life(F.lit(0.5)).alias("h"), hazard.logistic_hazard((0.0, 1.0), F.lit(100.0)).alias("z")).first()
    assert row["p"] == 0.5 and row["h"] == pytest.approx(1.0) and row["z"] == pytest.approx(1 / (1 + np.exp(-20)))


def test_interval_priority(spark):
    points = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 50.0)], "id long, x double")
    bands = spark.createDataFrame([(0.0, 10.0, "low", 1), (8.0, 12.0, "mid", 2)], "low double, high double, label string, priority int")
    assert {r["id"]: r["label"] for r in events.interval_labels(points, bands).collect()} == {1: "low", 2: "mid", 3: "normal"}


# Sources and sinks


def test_formats(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [\n node [ id 1 value 0 label "a" ]\n node [ id 2 value 1 ]\n edge [ source 1 target 2 ]\n edge [ source 1 target 2 ]\n]')
    nodes, edges = formats.read_gml(spark, f"file://{tmp_path}/g.gml")
    assert {(r["id"], r["label"]) for r in nodes.collect()} == {(1, 0), (2, 1)} and edges.count() == 1
    (tmp_path / "e.txt").write_text("# comment\n1 2\n% more\n3\tx\n4 5\n\n")
    assert sorted(map(tuple, formats.read_edges(spark, f"file://{tmp_path}/e.txt").collect())) == [(1, 2), (4, 5)]
    row = spark.range(1).select(F.lit(float("nan")).alias("a"), F.lit(1.5).alias("b"), F.lit(float("inf")).alias("c"))
    assert json.loads(formats.as_json(row).first()["value"]) == {"a": None, "b": 1.5, "c": None}
    formats.append_log(spark.range(2), f"file://{tmp_path}/log", "2024-01-01")
    formats.append_log(spark.range(3), f"file://{tmp_path}/log", "2024-01-02")
    assert spark.read.parquet(f"file://{tmp_path}/log").groupBy("run_date").count().count() == 2
    before = spark.createDataFrame(formats.manifest(spark, f"file://{tmp_path}/e.txt").collect())
    (tmp_path / "e.txt").write_text("1 3\n")
    assert formats.changed(before, formats.manifest(spark, f"file://{tmp_path}/e.txt")).count() == 1


def test_kept_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,x,extra\n2024-01-01,1.5,q\n2024-01-02,oops,r\n")
    got = formats.read_required_csv(spark, f"file://{tmp_path}/a.csv", "date date, x double, y double", ["date", "x"]).orderBy("date").collect()
    assert [(r["x"], r["y"]) for r in got] == [(1.5, None), (None, None)]
    with pytest.raises(ValueError, match="y"):
        formats.read_required_csv(spark, f"file://{tmp_path}/a.csv", "date date, y double", ["date", "y"])
    panel = spark.createDataFrame([("u", day(k), a, float(k)) for k in range(6) for a in "ab"], "uid string, t date, asset string, x double")
    place = f"file://{tmp_path}/panel"
    assert formats.append_new(panel.where(F.col("t") < day(3)), place).count() == 6
    assert formats.append_new(panel.withColumn("x", F.col("x") + 100), place).where("x >= 100").count() == 6  # kept rows stay
    place = f"file://{tmp_path}/days"
    for date, n in (("2024-01-01", 3), ("2024-01-02", 4), ("2024-01-01", 5)):
        formats.archive_snapshot(spark.range(n), place, date)
    assert {str(r["run_date"]): r["count"] for r in spark.read.parquet(place).groupBy("run_date").count().collect()} == {"2024-01-01": 5, "2024-01-02": 4}
    levels = lambda rows: spark.createDataFrame(rows, "uid string, alert string")
    changed = formats.new_alerts(levels([("a", "WATCH"), ("b", "NOMINAL")]), levels([("a", "WARNING"), ("b", "NOMINAL"), ("c", "WATCH")]), "2024-01-02")
    assert {(r["uid"], r["before"], r["after"]) for r in changed.collect()} == {("a", "WATCH", "WARNING"), ("c", None, "WATCH")}
    model = {"weights": np.arange(6.0).reshape(2, 3), "numbers": np.array([1, 2], np.int64)}
    formats.save_arrays(spark, f"file://{tmp_path}/model", model)
    back = formats.load_arrays(spark, f"file://{tmp_path}/model")
    assert set(back) == set(model) and all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in model.items())


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT eigenvalues(array(array(1D, 0.5D), array(0.5D, 1D))) AS e").first()
    assert row["e"] == pytest.approx([1.5, 0.5])


# Streaming


def test_streams_equal_batches(spark, tmp_path):
    from lattica import streaming

    rows = [(k, day(0), 1, "view", float(k % 7)) for k in range(60)]
    base = spark.createDataFrame(rows, "event_id long, d date, user_id long, event_type string, value double")
    at = base.select("event_id", (F.to_timestamp("d") + F.make_interval(mins=F.col("event_id").cast("int") * 7)).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    folder = f"file://{tmp_path}/in"
    at.where("event_id < 30").coalesce(1).write.parquet(folder)
    at.where("event_id >= 30").coalesce(1).write.mode("append").parquet(folder)
    query = streaming.windowed(streaming.event_stream(spark, folder)).writeStream.format("memory").queryName("windows_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["start"], r["n"]) for r in spark.table("windows_out").collect()}
    expected = at.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).count().select(F.col("window.start").alias("start"), F.col("count").alias("n"))
    assert got == {(r["start"], r["n"]) for r in expected.collect()}
    late = f"file://{tmp_path}/late"
    for k, hours in enumerate(((0, 10), (2, 11), (20, 30))):  # the second batch brings rows of hours that are over
        part = spark.range(*hours).select(F.col("id").alias("event_id"), (F.lit(day(0)).cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        part.coalesce(1).write.mode("append").parquet(late)
        query = streaming.windowed(streaming.event_stream(spark, late)).writeStream.format("parquet").option("path", f"{tmp_path}/late_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
        query.awaitTermination()
    closed = {r["start"].hour + 24 * (r["start"].date() - DAY).days: r["n"] for r in spark.read.parquet(f"{tmp_path}/late_out").collect()}
    # when the second batch came the watermark was at eight: earlier hours were written once, the late rows dropped
    assert closed == {**dict.fromkeys(range(8), 1), 8: 2, 9: 2, 10: 1, **dict.fromkeys(range(20, 28), 1)}
    memory = streaming.memory_by_key(streaming.event_stream(spark, folder), 3.0).writeStream.format("memory").queryName("memory_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").start()
    memory.processAllAvailable()
    memory.stop()
    found = {r["event_id"]: r["memory"] for r in spark.table("memory_out").collect()}
    own = series.leaky_memory(np.maximum(np.array([k % 7 for k in range(60)], float) - 3, 0), STATE.decay, STATE.memory_floor)
    assert len(found) == 60 and set(found) == set(range(60))
    assert sorted(found.values())[-1] <= own.max() + 7


def test_latent_structure_uses_all_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "embedding").toPandas()
    x, labels = np.stack(rows["embedding"]).astype(float), rows["label"].to_numpy()
    assert max(np.unique(labels, return_counts=True)[1]) > 40
    found = {r["label"]: r for r in catalog.QUERIES["latent_structure"](spark, sf_dir, block=200).collect()}
    assert set(found) == {None, *labels.tolist()} and found[None]["whole"]
    for label, r in found.items():
        own = x if label is None else x[labels == label]
        axes, share = kernels.principal(own, 3)
        assert r["rows"] == len(own) and np.allclose([r["share_1"], r["share_2"], r["share_3"]], share) and np.allclose(np.abs(np.dot(r["axis_1"], axes[0])), 1)
    assert found[None]["silhouette"] == pytest.approx(kernels.silhouette(x, labels))


def test_silhouettes_ask_each_pair_of_stripes_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    # far from zero, tight clusters, near and equal vectors, a label of one row
    x = (1000 + 50 * rng.normal(size=(4, 6))[rng.integers(0, 4, 300)] + 1e-2 * rng.normal(size=(300, 6))).astype(np.float32)
    x, labels = np.concatenate((x, x[:100])), np.concatenate((rng.integers(0, 6, 300), rng.integers(0, 6, 100)))
    labels[:100:2], labels[7] = labels[300::2], 99
    rows = [(k, v.tolist(), int(label)) for k, (v, label) in enumerate(zip(x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["label"]: r for r in catalog.QUERIES["latent_structure"](spark, str(tmp_path), block=5).collect()}
    assert found[None]["rows"] == 400 and found[99]["silhouette"] == 0
    assert found[None]["silhouette"] == pytest.approx(kernels.silhouette(x.astype(float), labels), rel=1e-7)
    # 200 blocks of 5 rows were 200 copies of each row on both sides; now as many as there are stripes, and one more
    of_rows = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 3).alias("label"))
    dealt, stripes = evaluation._striped(of_rows, 1000, 5)
    assert stripes <= 16 and dealt.count() == 1000 and dealt.groupBy("stripe").agg(F.count_distinct("label").alias("n")).agg(F.sum("n")).first()[0] <= stripes + 2


def test_pair_sums_where_products_lose_digits():
    rng = np.random.default_rng(4)
    base = 100 * rng.normal(size=(3, 8))
    for spread, odd in ((1.0, None), (1e-3, None), (0.0, None), (1.0, 1e8), (1.0, np.inf), (1.0, np.nan)):
        sides = [(base[rng.integers(0, 3, n)] + spread * rng.normal(size=(n, 8))).astype(np.float32) for n in (60, 90)]
        if odd is not None:
            sides[1][5, 2] = odd
        kinds = [np.sort(rng.integers(0, 4, len(v))) for v in sides]
        left, right = (pa.table({"embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": k, "times": np.arange(len(v)) % 3 + 1}) for v, k in zip(sides, kinds, strict=True))
        x, y = (v.astype(float) for v in sides)
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        w_x, w_y = (t["times"].to_numpy() for t in (left, right))
        to_right, to_left = evaluation._sums(left, right, 16)
        assert np.allclose(to_right, np.stack([(d * w_y)[:, kinds[1] == k].sum(1) for k in np.unique(kinds[1])], 1), rtol=1e-9, atol=0, equal_nan=True)
        assert np.allclose(to_left, np.stack([(d.T * w_x)[:, kinds[0] == k].sum(1) for k in np.unique(kinds[0])], 1), rtol=1e-9, atol=0, equal_nan=True)


# Contract


def test_names_and_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    told = lambda rows: sorted(str(tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)) for r in rows)
    expected = told(result.fetchall())
    df = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert told([r[n] for n in names] for r in df.collect()) == expected
