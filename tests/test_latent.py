"""Matrices of texts, insights by roles, even folds and leading axes against numpy and brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import attention, evaluate, rules
from lattica.plans import latent


def kind_of(c):
    c = c.lower() if c.isascii() else c
    for letter, pattern in attention.KINDS.items():
        if re.fullmatch(pattern, c):
            return letter
    return "O"


def brute_cells(texts):
    at = {k: i for i, k in enumerate(attention.LETTERS)}
    out = np.zeros((6, 6), int)
    for t in texts:
        kinds = [kind_of(c) for c in t or ""]
        for a, b in zip(kinds, kinds[1:], strict=False):
            out[at[a], at[b]] += 1
    return out


def test_text_matrices_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(c, t, "".join(rng.choice("aeiBC dD19 ,[]^_`~é☃\n\t\x0b𝄞\\") for _ in range(rng.randint(0, 60)))) for c in range(8) for t in range(rng.randint(1, 12))]
    rows += [(8, None, None), (8, 1, ""), (None, 0, "aab"), (9, 3, "a" * 30_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(3)
    got = {r["g"]: np.array(r["cells"]).reshape(6, 6) for r in attention.text_matrices(frame).collect()}
    for c in {r[0] for r in rows}:
        assert (got[c] == brute_cells([t for k, _, t in rows if k == c])).all()
    heads = attention.text_matrices(frame, heads=4)
    for r in heads.collect():
        own = [t for k, n, t in rows if k == r["g"] and (n or 0) % 4 == r["head"]]
        assert (np.array(r["cells"]).reshape(6, 6) == brute_cells(own)).all()
    assert attention.text_matrices(frame.where("false")).count() == 0


def test_spectra_of_heads(spark):
    rng = np.random.default_rng(8)
    rows = [(g, h, rng.integers(0, 9, 36).tolist()) for g in range(5) for h in range(g + 1)] + [(9, 0, [0] * 36), (10, 0, [3] * 36), (10, 1, [3] * 36)]
    got = {r["g"]: r for r in attention.spectra(spark.createDataFrame(rows, "g long, head int, cells array<long>")).collect()}
    for g in range(2, 5):
        x = np.array([c for k, _, c in rows if k == g], float)
        n = len(x)
        values = np.sort(np.linalg.eigvalsh(np.corrcoef(x)))[::-1]
        p = values / values.sum()
        p = p[p > 1e-12]
        assert got[g]["oh"] == pytest.approx(values[0], abs=1e-6) and got[g]["xi"] == pytest.approx(np.exp(-(p * np.log(p)).sum()) / n, abs=1e-6)
        assert got[g]["gap"] == pytest.approx((values[0] - values[1]) / values[0], abs=1e-6)
        edge = (1 + 1 / np.sqrt(36 / n)) ** 2
        assert got[g]["escaped"] == (values > edge).sum() and got[g]["escape"] == pytest.approx(got[g]["escaped"] / n)
        whole = x.sum(0).reshape(6, 6) / x.sum()
        low = np.tril(whole) + np.tril(whole, -1).T
        lam = np.sort(np.abs(np.linalg.eigvalsh(low)))[::-1]
        assert got[g]["phi"] == pytest.approx((lam[0] - lam[1]) / lam[0], abs=1e-6)
    assert got[0]["heads"] == 1 and got[0]["mean_corr"] == 0 and got[9]["phi"] == 0 and got[10]["oh"] == pytest.approx(1)
    # heads that copy each other escape the random edge
    same = [(0, h, (np.arange(36) + h).tolist()) for h in range(6)]
    r = attention.spectra(spark.createDataFrame(same, "g long, head int, cells array<long>")).first()
    assert r["escaped"] == 1 and r["mean_corr"] == pytest.approx(1) and r["score"] > 0.8


def test_each_insight_is_hit(spark):
    reports = spark.createDataFrame(
        [("a", "CRITICAL", "shift", 1.3, 1.0), ("b", "PRESSURIZED", "flow", 0.5, 0.0), ("c", "HEALTHY", "rigid", 0.9, 600.0), ("d", "HEALTHY", "rigid", 0.1, 101.0), ("e", "MONITORING", "flow", 2.0, None)],
        "uid string, status string, regime string, pressure double, viscosity double",
    )
    roles = {"a": ["safe_haven:1", "bellwether:1", "bellwether:2", "contagion:1", "growth:1", "commodity:1"], "b": ["safe_haven:1", "bellwether:1", "contagion:2", "growth:1", "defensive:1", "commodity:1", "macro_driver:1"], "c": ["fear_gauge:1"], "d": ["fear_gauge:1"]}
    members = spark.createDataFrame([(u, f"{r}", r.split(":")[0]) for u, own in roles.items() for r in own], "uid string, asset string, role string")
    got = {(r["uid"], r["insight"]): (r["kind"], r["severity"], r["assets"]) for r in rules.role_insights(reports, members).collect()}
    assert got == {
        ("a", "havens_coupled"): ("anomaly", "high", ["safe_haven:1"]),
        ("b", "havens_coupled"): ("anomaly", "medium", ["safe_haven:1"]),
        ("a", "bellwethers_locked"): ("structural", "high", ["bellwether:1", "bellwether:2"]),
        ("a", "contagion_channels"): ("contagion", "high", ["contagion:1"]),
        ("b", "contagion_channels"): ("contagion", "medium", ["contagion:2"]),
        ("b", "styles_converge"): ("anomaly", "medium", ["defensive:1", "growth:1"]),
        ("c", "rigid_persists"): ("regime", "high", []),
        ("d", "rigid_persists"): ("regime", "medium", []),
        ("c", "calm_beside_critical"): ("layer", "medium", []),
        ("d", "calm_beside_critical"): ("layer", "medium", []),
        ("c", "fear_stays_low"): ("warning", "low", ["fear_gauge:1"]),
        ("b", "commodities_follow_macro"): ("structural", "medium", ["commodity:1", "macro_driver:1"]),
    }
    assert {k for _, k in got} == {r["insight"] for r in rules.INSIGHTS}
    assert rules.role_insights(reports.where("uid = 'c'"), members).count() == 2  # nothing critical elsewhere


def test_folds_are_even_in_every_class(spark):
    rows = [(i, None if i % 11 == 0 else "rare" if i % 50 == 1 else "common") for i in range(1_203)]
    frame = spark.createDataFrame(rows, "i long, y string").repartition(4)
    got = evaluate.stratified_folds(frame, "y", F.sha2(F.col("i").cast("string"), 256), 7).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"i", "y", "fold"}
    counts = Counter((r["y"], r["fold"]) for r in got)
    for y in (None, "rare", "common"):
        own = [counts[y, k] for k in range(7)]
        assert max(own) - min(own) <= 1 and sum(own) == sum(v == y for _, v in rows)
    again = evaluate.stratified_folds(frame.repartition(2), "y", F.sha2(F.col("i").cast("string"), 256), 7)
    assert {r["i"]: r["fold"] for r in got} == {r["i"]: r["fold"] for r in again.collect()}


def test_leading_axes_and_what_explains_them(spark):
    rng = np.random.default_rng(10)
    label = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 5)) * np.where(label[:, None] == 2, [1, 1, 1, 6, 1], [5, 1, 1, 1, 1])
    frame = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x, strict=True)], "label int, embedding array<double>").repartition(3)
    axes = latent.leading_axes(frame)
    first = {}
    for k in range(3):
        own = x[label == k] - x[label == k].mean(0)
        first[k] = np.linalg.svd(own, full_matrices=False)[2][0]
    got = {(r["a"], r["b"]): r["cosine"] for r in latent.axis_pairs(axes).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), c in got.items():
        assert c == pytest.approx(abs(first[a] @ first[b]), abs=1e-9)
    assert latent.axis_pairs(axes, least_rows=1_000).count() == 0
    y = x @ [1.0, 2, 0, 0, 0] + rng.normal(size=400)
    rows = spark.createDataFrame([(float(a), *map(float, v)) for a, v in zip(y, x, strict=True)], "y double, a double, b double, c double, d double, e double")
    r2, each = latent.explained(rows, "y", list("abcde"))
    design = np.column_stack([np.ones(400), x])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert r2 == pytest.approx(1 - (rest @ rest) / ((y - y.mean()) @ (y - y.mean())), abs=1e-9)
    assert each["b"] == pytest.approx(np.corrcoef(x[:, 1], y)[0, 1], abs=1e-9)
    assert latent.explained(rows.withColumn("y", F.lit(1.0)), "y", ["a"])[0] == 0


def test_divergence_parts_equal_numpy(spark):
    import datetime

    from lattica.operators import series

    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2))
    rows = [("a", datetime.date(2020, 1, 1) + datetime.timedelta(i), float(p), float(q)) for i, (p, q) in enumerate(x)] + [("b", datetime.date(2020, 1, 1), 2.0, 0.0)]
    frame = spark.createDataFrame(rows, "uid string, t date, p double, q double")
    velocity = {
        "centred": np.gradient(x, axis=0),
        "forward": np.vstack([np.diff(x, axis=0), np.diff(x, axis=0)[-1:]]),
        "backward": np.vstack([np.diff(x, axis=0)[:1], np.diff(x, axis=0)]),
    }
    for how, v in velocity.items():
        got = series.divergence_parts(frame, ["p", "q"], how, horizon=2.0).orderBy("uid", "t").collect()
        relative = np.linalg.norm(2 * v, axis=1) / np.maximum(np.linalg.norm(x, axis=1), 1e-10)
        assert np.allclose([[r["part_p"], r["part_q"]] for r in got[:30]], np.abs(2 * v)) and np.allclose([r["relative"] for r in got[:30]], relative)
        assert got[0]["gradient"] is None and np.allclose([r["gradient"] for r in got[1:30]], np.diff(relative))
        assert (got[30]["total"], got[30]["gradient"]) == (0.0, None)


def test_reports_trends_and_periods(spark):
    import datetime

    from lattica.operators import events

    reports = spark.createDataFrame([("a", "CRITICAL"), ("b", "PRESSURIZED"), ("c", "CRITICAL"), ("d", "HEALTHY")], "uid string, status string")
    trends = spark.createDataFrame([("a", "rising"), ("b", "rising"), ("c", "rising"), ("d", "stable")], "uid string, direction string")
    r = events.global_trend(reports, trends).first()
    assert (r["rising"], r["falling"], r["trend"], r["critical"], r["alarmed"], r["contagion"]) == (3, 0, "deteriorating", 2, 3, "global")
    assert events.global_trend(reports.where("uid IN ('b', 'd')"), trends).first()["contagion"] == "regional"
    assert events.global_trend(reports.where("uid = 'd'"), trends).first()["contagion"] == "none"
    assert events.global_trend(reports.where("false"), trends).count() == 0
    universes = spark.createDataFrame([("a",), ("z",), ("z",)], "uid string")
    assert {x["uid"]: x["status"] for x in events.with_errors(reports, universes).collect()} == {"a": "CRITICAL", "z": "ERROR"}
    day = lambda k: datetime.date(2024, 1, k)
    rows = spark.createDataFrame([(day(k), float(k)) for k in range(1, 11)], "t date, x double")
    periods = spark.createDataFrame([(day(2), day(4)), (day(3), day(5)), (day(9), day(9))], "low date, high date")
    x = events.semi_anti(rows, periods, ["x"]).first()
    assert (x["n_normal"], x["n_extreme"], x["extreme"], x["normal"]) == (5, 5, 4.6, 6.4) and x["delta"] == pytest.approx(-1.8)


def test_normalised_and_mean_heads(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-2, 9, (3, 4, 4)).astype(float)
    rows = [(0, h, i, j, float(a[h, i, j])) for h in range(3) for i in range(4) for j in range(4)] + [(1, 0, 0, 0, 0.0), (1, 0, 0, 1, 0.0)]
    mean = attention.mean_of_heads(spark.createDataFrame(rows, "g long, head int, i int, j int, a double"))
    m = np.maximum(a.mean(0), 0)
    for how, expected in (("none", m), ("sum", m / m.sum()), ("max", m / m.max()), ("row", m / np.maximum(m.sum(1, keepdims=True), 1e-10))):
        got = {(r["g"], r["i"], r["j"]): r["a"] for r in attention.normalised(mean, how).collect()}
        assert all(got[0, i, j] == pytest.approx(expected[i, j]) for i in range(4) for j in range(4)) and got[1, 0, 1] == 0


def test_presets_sum_their_parts(spark):
    frame = spark.createDataFrame([(1, 0.4, 0.5, 0.6, 0.7, 0.2)], "g long, rscore double, eta double, xi double, delta double, omega double")
    got = {r["preset"]: r for r in attention.preset_scores(frame).collect()}
    assert set(got) == set(attention.PRESETS)
    assert got["balanced"]["score"] == pytest.approx(0.25 * 0.4 + 0.25 * 0.5 + 0.2 * 0.4 + 0.15 * 0.7 - 0.15 * 0.2)
    for r in got.values():
        assert r["score"] == pytest.approx(sum(v for k, v in r.asDict().items() if k.startswith("part_")), abs=3e-6)


def test_runs_and_wide_files(spark, tmp_path):
    import datetime
    import json

    from lattica.sources import formats

    place = f"file://{tmp_path}/run"
    state = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "uid string, t int, oh double")
    viscosity = spark.createDataFrame([("a", 3.5, float("nan")), ("b", 1.0, None)], "uid string, nu double, tau double")
    formats.write_run(place, state, viscosity, spark.createDataFrame([("a", float("inf")), ("b", 2.0)], "uid string, oh_max double"))
    rows, metrics = formats.read_run(spark, place)
    assert sorted((r["uid"], r["t"], r["oh"]) for r in rows.collect()) == [("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)]
    told = {r["uid"]: r["metrics"] for r in metrics.collect()}
    assert told["a"]["nu"] == 3.5 and math_nan(told["a"]["tau"]) and told["b"] == {"nu": 1.0, "tau": None}
    assert sorted(json.loads(r["value"])["oh_max"] or 0 for r in spark.read.text(f"{place}/report").collect()) == [0, 2.0]
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "north.csv").write_text("date,p,q\n2024-01-01,1.5,\n2024-01-02,2.5,3\n")
    (tmp_path / "wide" / "south.csv").write_text("date,p,q\n2024-01-02,8,7\n")
    got = sorted((r["uid"], r["t"], r["asset"], r["x"]) for r in formats.read_panel_csv(spark, f"file://{tmp_path}/wide", ["p", "q"]).where("x IS NOT NULL").collect())
    day = lambda k: datetime.date(2024, 1, k)
    assert got == [("north", day(1), "p", 1.5), ("north", day(2), "p", 2.5), ("north", day(2), "q", 3.0), ("south", day(2), "p", 8.0), ("south", day(2), "q", 7.0)]


def test_files_of_assets_with_headers_of_their_own(spark, tmp_path):
    import datetime

    from lattica.sources import formats

    for name, text in {
        "AAA": "Date,Open,Close,Adj Close\n2024-01-01,1,2,3\n2024-01-02,1,,3\n\nbad,1,1,1\n",
        "BBB": "Date,Adj Close,Open\r\n2024-01-02,9.5,1\r\n2024-01-03,nan,1\r\n",
        "CCC": "Date,Open\n2024-01-01,5\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = sorted(map(tuple, formats.read_asset_files(spark, f"file://{tmp_path}").collect()))
    assert got == [(datetime.date(2024, 1, 1), "AAA", 2.0), (datetime.date(2024, 1, 2), "BBB", 9.5)]


def math_nan(x):
    return x is not None and x != x
