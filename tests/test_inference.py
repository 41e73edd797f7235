"""Permuted labels, tails of the trend and rises of quiet windows against numpy and plain formulas."""

import datetime
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.config import STATE
from lattica.operators import fits, state
from lattica.plans import evaluation


def rows_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - 0.4 * x))).astype(int)
    frame = spark.createDataFrame([(int(i), float(a), int(b)) for i, a, b in zip(range(n), x, y, strict=True)], "i long, x double, y int")
    return frame.withColumn("row", F.xxhash64("i")).repartition(3), x, y


def test_each_permutation_has_the_observed_ones(spark):
    frame, _, y = rows_of(spark, 5_000)
    draws = np.arange(1, 41)
    limits = fits.permutation_limits(frame, int(y.sum()), draws)
    own = np.array([r["row"] for r in frame.select("row").collect()])
    label = fits.hashed(own, draws) <= limits
    assert (label.sum(0) == y.sum()).all() and len({tuple(c) for c in label.T.tolist()}) == 40
    assert (fits.hashed(own, draws) <= fits.permutation_limits(frame, 5_000, draws)).all()
    assert ((fits.hashed(own, draws) <= fits.permutation_limits(frame, 1, draws)).sum(0) == 1).all()
    # every row is as likely as any other
    share = label.mean(1)
    assert abs(share.mean() - y.mean()) < 1e-12 and abs(share.var() - y.mean() * (1 - y.mean()) / 40) < 0.15 * y.mean() * (1 - y.mean()) / 40


def test_permutation_refuses_equal_rows_and_too_many(spark):
    frame, _, _ = rows_of(spark, 50)
    with pytest.raises(ValueError, match="more rows"):
        fits.permutation_limits(frame, 51, np.arange(3))
    with pytest.raises(ValueError, match="distinct"):
        fits.permutation_limits(frame.withColumn("row", F.lit(7).cast("long")), 5, np.arange(3))


def auc_of(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_permuted_separations_are_as_numpys(spark):
    frame, x, y = rows_of(spark, 400, seed=5)
    draws = np.arange(1, 301)
    limits = fits.permutation_limits(frame, int(y.sum()), draws)
    labels = lambda batch: fits.hashed(batch.column("row").to_numpy(), draws) <= limits
    found = evaluation._null_aucs(frame, lambda batch: np.repeat(batch.column("x").to_numpy()[:, None], 300, axis=1), labels, 300)
    rng = np.random.default_rng(9)
    theirs = np.array([auc_of(x, rng.permutation(y)) for _ in range(300)])
    assert abs(found.mean() - theirs.mean()) < 4 * theirs.std() / math.sqrt(150) and 0.8 < found.std() / theirs.std() < 1.25
    by_row = {r["row"]: r["x"] for r in frame.collect()}
    own = np.array(list(by_row))
    drawn = fits.hashed(own, draws[:1]) <= limits[:1]
    assert found[0] == pytest.approx(auc_of(np.round([by_row[r] for r in own], 12), drawn[:, 0].astype(int)), abs=1e-6)


def test_models_with_labels_of_their_own(spark):
    frame, x, y = rows_of(spark, 300, seed=2)
    flipped = lambda batch: np.column_stack([batch.column("y").to_numpy(), 1 - batch.column("y").to_numpy()])
    two, _ = fits.logistic_models(frame, ["x"], 2, lambda batch: np.ones((batch.num_rows, 2)), target=flipped)
    one, _ = fits.logistic_models(frame, ["x"], 1, lambda batch: np.ones((batch.num_rows, 1)))
    assert np.allclose(two[0], one[0]) and np.allclose(two[1], -one[0], atol=1e-7)


def tail_by_sum(r, n):
    """Two tails of Student's t by its density, summed finely."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    grid = np.linspace(0, t, 200_001)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(density, grid)


def test_trend_tails(spark):
    cases = [(r, n) for n in (3, 4, 5, 6, 7, 20, 21, 53, 252, 253) for r in (0.0, 0.1, -0.45, 0.8, 0.99)]
    frame = spark.createDataFrame([(i, float(r), n) for i, (r, n) in enumerate(cases)], "i int, r double, n int")
    got = {x["i"]: x["p"] for x in frame.withColumn("p", state.correlation_p(F.col("r"), F.col("n"))).collect()}
    for i, (r, n) in enumerate(cases):
        assert got[i] == pytest.approx(tail_by_sum(r, n), abs=1e-9), (r, n)
    edge = spark.createDataFrame([(1.0, 10), (0.5, 2), (0.5, 1), (-1.0, 11)], "r double, n int").select(state.correlation_p(F.col("r"), F.col("n")).alias("p"))
    assert [r["p"] for r in edge.collect()] == [0.0, None, None, 0.0]


def plain_rise(eta):
    """The rise by its formula, step by step."""
    n = len(eta)
    if n < 40:
        return 0.0, 0.0
    raw = [round(max(np.quantile(eta, 0.05), 1e-12) / (e + 1e-12), 9) for e in eta]
    pre = np.quantile(raw, 0.968)
    phi, before = [], 0.0
    for x in raw:
        before = max(0.97 * before + max(round(x - (pre + 0.08), 9), 0.0), 1e-6)
        phi.append(before)
    step = [max(round(b - a, 9), 0.0) for a, b in zip(phi, phi[1:], strict=False)]
    t0 = int(0.75 * n)
    ratio = np.median(step[max(0, t0 - 1) :]) / (np.median(step[: max(3, t0 - 1)]) + 1e-12)
    slope = np.polyfit(np.arange(n - t0), phi[t0:], 1)[0] * 252 if n - t0 >= 8 else 0.0
    return max(0.0, ratio - 1.5), max(0.0, slope)


def test_rise_of_quiet_windows(spark):
    rng = np.random.default_rng(4)
    calm = 1 + 0.01 * rng.normal(size=60)
    building = np.concatenate([calm[:50], 1 / (1 + 0.2 * np.arange(1, 11))])
    for eta in (calm, building, building[-39:], building[-40:], np.ones(45), rng.random(72)):
        assert state.rise_at_end(eta) == pytest.approx(plain_rise(eta.tolist()), rel=1e-9, abs=1e-9)
    assert state.rise_at_end(building)[1] > state.rise_at_end(calm)[1]
    day = datetime.date(2020, 1, 1)
    rows = [(u, day + datetime.timedelta(7 * i), float(e)) for u, x in (("a", calm), ("b", building)) for i, e in enumerate(x)]
    frame = spark.createDataFrame(rows, "uid string, t date, eta double")
    candidates = spark.createDataFrame([(u, k, day + datetime.timedelta(7 * s), day + datetime.timedelta(7 * 59)) for u in "ab" for k, s in enumerate((0, 10, 30))], "uid string, k int, start date, end date")
    got = {(r["uid"], r["k"]): r["penalty"] for r in state.quiet_rises(frame, candidates).collect()}
    for u, x in (("a", calm), ("b", building)):
        for k, s in enumerate((0, 10, 30)):
            ratio, slope = plain_rise(x[s:].tolist())
            assert got[u, k] == pytest.approx(0.5 * ratio + 0.5 * slope, abs=1e-5)
    assert got["b", 2] == 0 < got["b", 0] and STATE.rise_rows == 40


def test_no_quiet_window_is_an_error(spark):
    top = spark.createDataFrame([("a", 1)], "uid string, rank int")
    universes = spark.createDataFrame([("a",), ("b",)], "uid string")
    assert state.quiet_required(universes.where("uid = 'a'"), top).count() == 1
    with pytest.raises(PySparkException, match="no quiet window in universe b"):
        state.quiet_required(universes, top).collect()
