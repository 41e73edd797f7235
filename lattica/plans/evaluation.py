"""Queries on evaluation, attention, sources and kernels, registered in the catalogue."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import kernels
from lattica.operators import attention, evaluate, fits, series, windows
from lattica.plans import oracle as o
from lattica.plans.catalog import _oh_state, all_returns, one_returns, query, r6
from lattica.runtime import remembered, table, written
from lattica.sources import formats, panels

SCORED = """labelled AS (
  SELECT d.doc_id, l.quality, l.toxic, d.source, CAST(n_chars AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / greatest(length(text), 1) AS spaces,
         CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) / greatest(length(text), 1) AS marks FROM documents d JOIN labels l USING (doc_id)
), scored AS (SELECT 'quality' AS g, round(1 / (1 + exp(-(1.5::DOUBLE + 4 * spaces - 30 * marks))), 6) AS score, quality AS y FROM labelled
), th AS (SELECT g, score, sum(y) AS pos, sum(1 - y) AS neg FROM {scored} GROUP BY g, score
), cum AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM th WINDOW d AS (PARTITION BY g ORDER BY score DESC), a AS (PARTITION BY g))"""
ONE_SCORE = SCORED.format(scored="scored")


def labelled(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = lambda c: (F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit(c), F.lit("")))).cast("double") / F.greatest(F.char_length("text"), F.lit(1))
    return docs.join(labels, "doc_id").select("doc_id", "quality", "toxic", "source", F.col("n_chars").cast("double").alias("length"), share(" ").alias("spaces"), share("!").alias("marks"))


def scored(spark, sf_dir) -> DataFrame:
    line = 1.5 + 4 * F.col("spaces") - 30 * F.col("marks")
    return labelled(spark, sf_dir).select(F.lit("quality").alias("g"), F.round(1 / (1 + F.exp(-line)), 6).alias("score"), F.col("quality").alias("y"))


AUC = "SELECT g, CAST(any_value(p) AS BIGINT) AS positives, CAST(any_value(n) AS BIGINT) AS negatives, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (any_value(p) * any_value(n)), 6) AS auc FROM cum GROUP BY g"


@query(o.sql(ONE_SCORE, AUC))
def auc_rank(spark, sf_dir):
    return evaluate.rank_auc(scored(spark, sf_dir))


@query(o.sql(ONE_SCORE, "SELECT g, round(sum(CAST(pos AS DOUBLE) / p * tp / (tp + fp)), 6) AS ap FROM cum GROUP BY g"))
def average_precision(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir))


@query(o.sql(ONE_SCORE, "SELECT g, threshold, j FROM (SELECT g, round(score, 6) AS threshold, round(round(tp / p::DOUBLE - fp / n::DOUBLE, 9), 6) AS j, row_number() OVER (PARTITION BY g ORDER BY round(tp / p::DOUBLE - fp / n::DOUBLE, 9) DESC, score DESC) AS r FROM cum) WHERE r = 1"))
def youden_threshold(spark, sf_dir):
    return evaluate.youden(scored(spark, sf_dir))


@query(o.sql(ONE_SCORE, """bins AS (SELECT g, least(floor(score * 10), 9) AS bin, abs(avg(y) - avg(score)) AS gap FROM scored GROUP BY 1, 2
), ece AS (SELECT g, round(avg(gap), 6) AS ece, count(*) AS bins FROM bins GROUP BY g)""", "SELECT s.g, round(avg((score - y) * (score - y)), 6) AS brier, round(avg(-(y * ln(score) + (1 - y) * ln(1 - score))), 6) AS log_loss, any_value(ece) AS ece, any_value(bins) AS bins FROM scored s JOIN ece USING (g) GROUP BY s.g"))
def calibration_ece(spark, sf_dir):
    return evaluate.calibration(scored(spark, sf_dir))


@query(o.sql(ONE_SCORE, "c AS (SELECT g, count(*) FILTER (score > 0.9 AND y = 1) AS tp, count(*) FILTER (score > 0.9 AND y = 0) AS fp, count(*) FILTER (score <= 0.9 AND y = 1) AS fn, count(*) FILTER (score <= 0.9 AND y = 0) AS tn FROM scored GROUP BY g)",
             "SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"))
def confusion_metrics(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), F.lit(0.9))


@query(o.sql(ONE_SCORE, "SELECT g, round(quantile_cont(score, 0.95), 6) AS threshold FROM scored WHERE y = 0 GROUP BY g"))
def threshold_at_fpr(spark, sf_dir):
    return evaluate.threshold_at_rate(scored(spark, sf_dir), 0.05)


LONG = SCORED.split("\n), scored AS")[0] + """
), long AS (SELECT quality AS y, unnest(['length', 'spaces', 'marks']) AS g, unnest([length, round(spaces, 9), round(marks, 9)]) AS score FROM labelled
""" + SCORED[SCORED.index("), th AS"):].format(scored="long")


@query(o.sql(LONG, f"found AS ({AUC})", "SELECT g, positives, negatives, greatest(auc, round(1 - auc, 6)) AS auc FROM found"))
def feature_auc_scan(spark, sf_dir):
    frame = labelled(spark, sf_dir).withColumn("spaces", F.round("spaces", 9)).withColumn("marks", F.round("marks", 9))
    return evaluate.folded_auc(evaluate.unpivoted(frame, ["length", "spaces", "marks"], "quality"))


@query(o.sql(LONG.split("\n), long AS")[0] + ")", "SELECT source AS g, count(*) AS n, round(avg(round(spaces, 9) - round(marks, 9)), 6) AS mean_diff, round(avg(round(spaces, 9) - round(marks, 9)) / (stddev_samp(round(spaces, 9) - round(marks, 9)) / sqrt(count(*))), 6) AS t FROM labelled GROUP BY source HAVING count(*) > 1"))
def paired_difference(spark, sf_dir):
    pairs = labelled(spark, sf_dir).select(F.col("source").alias("g"), F.round("spaces", 9).alias("x"), F.round("marks", 9).alias("y"))
    return evaluate.paired_t(pairs).where("n > 1")


# Attention -------------------------------------------------------------------------------------------------------

SIZE = 12
ATTENTION = f"""cells AS (SELECT i, j FROM range({SIZE}) a(i), range({SIZE}) b(j)
), att AS (
  SELECT 'uniform' AS g, i, j, 1.0::DOUBLE / {SIZE} AS a FROM cells UNION ALL SELECT 'diagonal', i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM cells
  UNION ALL SELECT 'concentrated', i, j, CASE WHEN j = 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE / {SIZE - 1} END FROM cells
  UNION ALL SELECT 'causal', i, j, CASE WHEN j <= i THEN 1.0::DOUBLE / (i + 1) ELSE 0.0::DOUBLE END FROM cells
), moves AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f, role AS r FROM conversations
), roles AS (SELECT * FROM (VALUES ('assistant', 0), ('system', 1), ('user', 2)) v(role, k)
), trans AS (SELECT 'roles' AS g, a.k AS i, b.k AS j, CAST(count(m.f) AS DOUBLE) AS a FROM roles a CROSS JOIN roles b LEFT JOIN moves m ON m.f = a.role AND m.r = b.role GROUP BY 2, 3
), matrices AS (SELECT * FROM att UNION ALL SELECT * FROM trans
), ps AS (SELECT g, i, j, a, a / sum(a) OVER (PARTITION BY g) AS p, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY a, i, j) AS r FROM matrices
), fam AS (
  SELECT g, coalesce(-sum(CASE WHEN p > 1e-10 THEN p * log2(p) END), 0) AS bits, CAST(max(n) AS DOUBLE) AS m, sum(p * p) AS square, sum(p * (2 * r - n - 1)) AS spread FROM ps GROUP BY g
), family AS (
  SELECT g, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, bits / log2(m))), 6) AS omega, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - bits / log2(m))), 6) AS eta, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, spread / m)), 6) AS gini,
         round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 / (square * m))), 6) AS xi, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, log2(m) - bits)), 6) AS delta FROM fam)"""


def matrices(spark, sf_dir) -> DataFrame:
    """The stated regimes and the roles' transitions in conversations."""
    roles = spark.createDataFrame([("assistant", 0), ("system", 1), ("user", 2)], "role string, k long")
    turns = table(spark, sf_dir, "conversations")
    moves = turns.select(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("f"), F.col("role").alias("r"))
    pairs = spark.range(9).select(F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).alias("j"))
    cells = pairs.join(roles.select(F.col("role").alias("f"), F.col("k").alias("i")), "i").join(roles.select(F.col("role").alias("r"), F.col("k").alias("j")), "j")
    counted = cells.join(moves.where("f IS NOT NULL").groupBy("f", "r").agg(F.count(F.lit(1)).alias("n")), ["f", "r"], "left")
    trans = counted.select(F.lit("roles").alias("g"), "i", "j", F.coalesce("n", F.lit(0)).cast("double").alias("a"))
    return attention.synthetic_attention(spark, SIZE).unionByName(trans)


@query(o.sql(ATTENTION, "SELECT * FROM family"))
def attention_entropy_family(spark, sf_dir):
    return attention.entropy_family(matrices(spark, sf_dir))


@query(o.sql(ATTENTION, "SELECT min(omega) AS omega_min, round(avg(omega), 6) AS omega_mean, max(eta) AS eta_max, max(gini) AS gini_max, min(xi) AS xi_min, max(delta) AS delta_max FROM family"))
def attention_pooling(spark, sf_dir):
    f = attention.entropy_family(matrices(spark, sf_dir))
    return f.agg(F.min("omega").alias("omega_min"), F.round(F.avg("omega"), 6).alias("omega_mean"), F.max("eta").alias("eta_max"), F.max("gini").alias("gini_max"), F.min("xi").alias("xi_min"), F.max("delta").alias("delta_max"))


@query(o.sql(ATTENTION, "SELECT g, i, j, round(coalesce(a / nullif(sum(a) OVER (PARTITION BY g, i), 0), 0), 6) AS by_row, round(coalesce(a / nullif(max(a) OVER (PARTITION BY g), 0), 0), 6) AS by_max, round(coalesce((sqrt(a) - min(sqrt(a)) OVER (PARTITION BY g)) / nullif(max(sqrt(a)) OVER (PARTITION BY g) - min(sqrt(a)) OVER (PARTITION BY g), 0), 0), 6) AS contrast FROM matrices"))
def attention_normalised(spark, sf_dir):
    base = matrices(spark, sf_dir)
    out = base.select("g", "i", "j")
    for name, frame in (("by_row", attention.normalised(base)), ("by_max", attention.normalised(base, "max")), ("contrast", attention.contrasted(base))):
        out = out.join(frame.select("g", "i", "j", F.round("a", 6).alias(name)), ["g", "i", "j"])
    return out


COMPOSITE = "0.30::DOUBLE * (1 - xi) + 0.25::DOUBLE * eta + 0.20::DOUBLE * (1 - xi) + 0.15::DOUBLE * delta - 0.10::DOUBLE * omega"


@query(o.sql(ATTENTION, f"s AS (SELECT g, round({COMPOSITE}, 6) AS score FROM family)", "SELECT g, score, score > 0.5 AS detected, round(least(1.0::DOUBLE, abs(score - 0.5::DOUBLE) / 0.5::DOUBLE), 6) AS confidence FROM s"))
def composite_detect(spark, sf_dir):
    f = attention.entropy_family(matrices(spark, sf_dir)).withColumn("rscore", 1 - F.col("xi"))
    return attention.detected(attention.composite(f)).select("g", "score", "detected", "confidence")


def distance_sql(centre: tuple) -> str:
    return "round(sqrt(" + " + ".join(f"({c} - {x}::DOUBLE) * ({c} - {x}::DOUBLE)" for c, x in zip(("omega", "eta", "xi", "delta", "gini"), centre, strict=True)) + "), 6)"


@query(o.sql(ATTENTION, "ds AS (SELECT g, " + ", ".join(f"{distance_sql(v)} AS d_{k}" for k, v in attention.CENTRES.items()) + " FROM family)", "SELECT g, d_flow, d_shift, d_rigid, CASE WHEN d_flow <= d_rigid AND d_flow <= d_shift THEN 'flow' WHEN d_rigid <= d_shift THEN 'rigid' ELSE 'shift' END AS regime, round(exp(-d_flow) / (exp(-d_flow) + exp(-d_shift) + exp(-d_rigid)), 6) AS m_flow FROM ds"))
def regime_soft_classify(spark, sf_dir):
    return attention.nearest_regime(attention.entropy_family(matrices(spark, sf_dir))).select("g", "d_flow", "d_shift", "d_rigid", "regime", "m_flow")


# Kernels: no SQL ---------------------------------------------------------------------------------------------------


@query()
def window_state_full(spark, sf_dir):
    return windows.by_window(all_returns(spark, sf_dir), 22, windows.full_state, windows.STATE_COLUMNS)


@query()
def eigen_five_tuple(spark, sf_dir):
    return windows.by_window(all_returns(spark, sf_dir), 22, windows.spectral_state, windows.SPECTRAL_COLUMNS)


@query()
def rips_barcodes(spark, sf_dir):
    return windows.by_window(one_returns(spark, sf_dir), 22, windows.barcode_state, ["h0_total", "h1_bars", "persistence_entropy"])


@query()
def engagement_windows(spark, sf_dir):
    return windows.by_window(one_returns(spark, sf_dir), 10, windows.engagement_state, ["oh", "eta", "mean_corr", "gap", "xi", "active"])


RECURRED = o.recurrence_sql("series", "x")
RATES = ", ".join(f"round({c}, 6) AS {c}" for c in ("rr", "det", "lam", "tt")) + ", round(theta + 1e-11, 6) AS theta"


@query(o.sql(o.REVENUE, RECURRED, f"SELECT uid, t, {RATES}, geometry FROM recurred"))
def rqa_rolling(spark, sf_dir):
    """Recurrence of daily revenue over the 60 days before each."""
    return windows.recurrence_series(panels.revenue_series(spark, sf_dir)).select("uid", "t", *r6("rr", "det", "lam", "tt"), F.round(F.round("theta", 9) + 1e-11, 6).alias("theta"), "geometry")


@query(o.sql(o.REVENUE, o.lag_sql("series", "x"), "SELECT uid, lag FROM lagged"))
def embedding_lag(spark, sf_dir):
    return windows.lags(panels.revenue_series(spark, sf_dir))


def activation_sql(source: str, x: str) -> str:
    """``activated``: the kind of a numbered series' first lasting activation, as ``series.activations`` has it."""
    return f"""flagged AS (SELECT uid, rn - 1 AS t, {x} > 0.5 AS flag FROM {source}
), {o.RUNS}, lasting AS (SELECT uid, min("start") AS start, arg_min(length, "start") AS lasting FROM runs WHERE flag AND length >= 5 GROUP BY uid
), stirred AS (SELECT uid, rn - 1 AS i, n, {x} AS x, {x} < lead({x}) OVER (PARTITION BY uid ORDER BY rn) OR {x} > 0.05 AS stirs FROM {source}
), summed AS (
  SELECT s.uid, max(n) AS n, max(l.start) AS start, max(lasting) AS lasting, min(i) FILTER (i >= l.start + 5 AND x < 0.1) AS low,
         coalesce(max(i) FILTER (i < l.start AND i >= l.start - 60 AND NOT stirs), greatest(max(l.start) - 60, 0) - 1) AS still FROM stirred s LEFT JOIN lasting l USING (uid) GROUP BY s.uid
), ends AS (SELECT uid, max("end") AS e, arg_max(length, "end") AS len FROM runs WHERE flag GROUP BY uid
), now AS (SELECT s.*, CASE WHEN e = n - 1 THEN len ELSE 0 END AS now FROM summed s LEFT JOIN ends USING (uid)
), activated AS (
  SELECT uid, CASE WHEN start IS NULL THEN 'NONE' WHEN greatest(lasting, now) >= 30 THEN 'RAMP' WHEN low < start + 20 THEN 'SPIKE' ELSE 'BUILDING' END AS kind,
         CAST(coalesce(start, -1) AS BIGINT) AS start, CAST(CASE WHEN start IS NULL THEN -1 WHEN now >= 5 THEN n - now ELSE start END AS BIGINT) AS effective_start,
         CAST(CASE WHEN start IS NULL THEN 0 ELSE now END AS BIGINT) AS current_run, CAST(coalesce(start - 1 - still, 0) AS BIGINT) AS growth,
         CAST(CASE WHEN start IS NULL THEN 0 WHEN lasting < 30 AND now >= 30 THEN now ELSE lasting END AS BIGINT) AS persistence,
         CAST(CASE WHEN start IS NULL THEN 0 WHEN now >= 5 THEN now ELSE coalesce(low, n) - start END AS BIGINT) AS duration FROM now)"""


@query(o.sql(o.REVENUE, RECURRED, activation_sql("recurred", "theta"), "SELECT * FROM activated"))
def theta_activation(spark, sf_dir):
    return series.activations(windows.recurrence_series(panels.revenue_series(spark, sf_dir)).select("uid", "t", F.round("theta", 9).alias("x")))


PRESSED = "pressed AS (SELECT uid, t, rn, n, greatest(0.0::DOUBLE, round(oh - 0.3, 9)) AS x FROM ohs)"


@query(o.sql(*o.WINDOWS, PRESSED, activation_sql("pressed", "x"), "SELECT * FROM activated"))
def pressure_activation(spark, sf_dir):
    """The same of the universes' pressure above 0.3."""
    return series.activations(_oh_state(spark, sf_dir).select("uid", "t", F.greatest(F.lit(0.0), F.round(F.col("oh") - 0.3, 9)).alias("x")))


@query()
def spot_check(spark, sf_dir):
    """Attractor strength of the last window by observable, and whether the observables agree."""
    frame = _oh_state(spark, sf_dir)
    values = F.create_map(*(x for c in ("oh", "eta", "mean_corr") for x in (F.lit(c), F.col(c))))
    return windows.spot_check(frame.select("uid", "t", F.explode(values).alias("observable", "x")))


def _training(spark, sf_dir) -> DataFrame:
    """Rows with a target, written: fits pass over them several times."""
    frame = _oh_state(spark, sf_dir)
    target = F.max((F.col("oh") > 0.9).cast("int")).over(Window.partitionBy("uid").orderBy("t").rowsBetween(1, 12))
    rows = frame.withColumn("y", target).where("y IS NOT NULL").select("uid", "t", "mean_corr", "eta", "vol", "oh", "y", F.xxhash64("uid", "t").alias("row"))
    return remembered(spark, ("training", sf_dir), sf_dir, ("orders", "customer", "nation", "region"), lambda: rows)


FEATURES = ["mean_corr", "eta", "vol", "oh"]
_all = lambda batch: np.ones((batch.num_rows, 1))


@query()
def hazard_logit_fit(spark, sf_dir):
    """Weights of the scaled logistic fit over all universes."""
    weights, _ = fits.logistic_models(_training(spark, sf_dir), FEATURES, 1, _all)
    return spark.createDataFrame(list(zip(["constant", *FEATURES], weights[0].tolist(), strict=True)), "term string, weight double")


def _out_of(names: list[str]) -> fits.Weigh:
    place = {u: k for k, u in enumerate(names)}

    def own(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([place[u] for u in batch.column("uid").to_pylist()])[:, None] == np.arange(len(names))

    return own


@query()
def louo_cv(spark, sf_dir):
    """Leave one universe out: a model for each, which counts the others' rows, and its separation of its own."""
    rows = _training(spark, sf_dir)
    names = [r["uid"] for r in rows.select("uid").distinct().orderBy("uid").collect()]  # universes are a stated few
    own = _out_of(names)
    _, plain = fits.logistic_models(rows, FEATURES, len(names), lambda batch: ~own(batch) * 1.0)
    known = np.isfinite(plain).all(1)
    scored = fits.scores(rows, FEATURES, np.nan_to_num(plain), lambda batch: own(batch) & known, ["uid", "y"])
    ranked = evaluate.rank_auc(scored.select(F.col("uid").alias("g"), F.round("score", 12).alias("score"), "y"))
    return ranked.where("positives > 0 AND negatives > 0").select(F.col("g").alias("fold"), (F.col("positives") + F.col("negatives")).alias("n"), "auc")


@query()
def bootstrap_ci(spark, sf_dir, draws: int = 1_000):
    """Intervals and sign stability of the fit's weights over resampled rows: a model for each draw."""
    number = np.arange(draws)
    weights, _ = fits.logistic_models(_training(spark, sf_dir), FEATURES, draws, lambda batch: fits.resampled(batch.column("row").to_numpy(), number))
    weights = weights[np.isfinite(weights).all(1)]
    low, middle, high = np.quantile(weights, [0.025, 0.5, 0.975], axis=0) if len(weights) else np.full((3, len(FEATURES) + 1), np.nan)
    rows = [(t, len(weights), *map(float, (low[k], middle[k], high[k], np.abs(np.sign(weights[:, k]).mean()) if len(weights) else np.nan))) for k, t in enumerate(["constant", *FEATURES])]
    return spark.createDataFrame(rows, "term string, draws long, low double, middle double, high double, sign_stability double")


@query()
def noise_feature(spark, sf_dir):
    """The fit with a feature of noise: what weight chance gets beside the others."""
    rows = _training(spark, sf_dir).withColumn("noise", F.pmod("row", F.lit(10_007)) / 10_007.0)
    weights, _ = fits.logistic_models(rows, [*FEATURES, "noise"], 1, _all)
    return spark.createDataFrame(list(zip(["constant", *FEATURES, "noise"], weights[0].tolist(), strict=True)), "term string, weight double")


@query()
def ablation(spark, sf_dir):
    """What separation the fit loses without each feature, and what it has by each alone."""
    rows, d = _training(spark, sf_dir), len(FEATURES)
    masks = np.concatenate([np.ones((1, d), bool), ~np.eye(d, dtype=bool), np.eye(d, dtype=bool)])
    weigh = lambda batch: np.ones((batch.num_rows, len(masks)))
    _, plain = fits.logistic_models(rows, FEATURES, len(masks), weigh, masks=masks)
    scored = fits.scores(rows, FEATURES, np.nan_to_num(plain), weigh, ["y"]).select(F.col("model").cast("string").alias("g"), F.round("score", 12).alias("score"), "y")
    names = F.array(*[F.lit(x) for x in ("full", *(f"without {f}" for f in FEATURES), *(f"{f} alone" for f in FEATURES))])
    found = evaluate.rank_auc(scored).select(F.element_at(names, F.col("g").cast("int") + 1).alias("model"), "auc")
    loss = F.round(F.max(F.when(F.col("model") == "full", F.col("auc"))).over(Window.partitionBy()) - F.col("auc"), 6)  # over a row a model
    told = F.when(F.col("loss") > 0.05, "CRITICAL").when(F.col("loss") > 0.01, "important").when(F.col("loss") > 0.001, "minor").otherwise("redundant")
    return found.withColumn("loss", loss).withColumn("meaning", F.when(F.col("model").startswith("without"), told))


def _null_aucs(rows: DataFrame, scores, labels, models: int) -> np.ndarray:
    """The separation of each model's scores (rows by models) of its own labels: scores of a model are ranked apart."""

    def task(batches):
        for batch in batches:
            s, y = scores(batch), labels(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(models), len(y))), pa.array(np.round(s, 12).ravel()), pa.array(y.astype(np.int32).ravel())], names=["g", "score", "y"])

    found = evaluate.rank_auc(rows.mapInArrow(task, "g long, score double, y int")).collect()
    out = np.full(models, np.nan)
    for r in found:
        out[r["g"]] = np.nan if r["auc"] is None else r["auc"]
    return out


@query()
def permutation_test(spark, sf_dir, shuffles: int = 100):
    """Separation by one score and by a fit of all features against the same on permuted labels, each with as many ones
    as there are; the fit is made anew for every permutation."""
    rows = _training(spark, sf_dir)
    ones, n = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    schema = "score string, auc double, null_mean double, null_max double, p double, permutations long"
    if not ones or ones == n:
        return spark.createDataFrame([], schema)
    draws = np.arange(1, shuffles + 1)
    limits = fits.permutation_limits(rows, ones, draws)

    def labels(batch: pa.RecordBatch) -> np.ndarray:
        own = batch.column("y").to_numpy(zero_copy_only=False).astype(bool)
        return np.column_stack([own, fits.hashed(batch.column("row").to_numpy(), draws) <= limits])

    models = shuffles + 1
    _, plain = fits.logistic_models(rows, FEATURES, models, lambda batch: np.ones((batch.num_rows, models)), target=labels)
    made = {
        "oh": lambda batch: np.repeat(batch.column("oh").to_numpy()[:, None], models, axis=1),
        "fit": lambda batch: 1 / (1 + np.exp(-np.clip(fits.design(batch, FEATURES) @ plain.T, -30, 30))),
    }
    out = []
    for name, scores in made.items():
        auc = _null_aucs(rows, scores, labels, models)
        out.append((name, float(auc[0]), float(auc[1:].mean()), float(auc[1:].max()), float((1 + (auc[1:] >= auc[0]).sum()) / models), shuffles))
    return spark.createDataFrame(out, schema)


def _moments(vectors: DataFrame, kind: str) -> DataFrame:
    """Per label and over all rows (``whole``): rows, means and sums of centred products, one row a task and label."""

    def task(batches):
        held, own = {}, None
        for batch in batches:
            own = batch.schema.field("label").type
            labels = np.array(batch.column("label").to_pylist())
            x = np.array(batch.column("embedding").to_pylist(), float)
            for label in np.unique(labels):
                held[label] = _merged([*held.get(label, []), _moment(x[labels == label])])
        rows = [(False, k, *v) for k, (v,) in held.items()]
        if rows:
            rows += [(True, None, *_merged([r[2:] for r in rows])[0])]
            numbers = pa.list_(pa.float64())
            schema = pa.schema([("whole", pa.bool_()), ("label", own), ("n", pa.int64()), ("mean", numbers), ("products", numbers)])
            yield pa.RecordBatch.from_pylist([{"whole": w, "label": None if k is None else k.item(), "n": n, "mean": m.tolist(), "products": c.ravel().tolist()} for w, k, n, m, c in rows], schema)

    return vectors.mapInArrow(task, f"whole boolean, label {kind}, n long, mean array<double>, products array<double>")


def _moment(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = x.mean(0)
    return len(x), mean, (x - mean).T @ (x - mean)


def _merged(parts: list) -> list:
    """One moment of several."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return [(n, mean, sum(c + k * np.outer(m - mean, m - mean) for k, m, c in parts))]


def _axes(table_: pa.Table) -> pa.Table:
    parts = [(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1)) for r in table_.to_pylist()]
    n, _, products = _merged(parts)[0]
    axis, share = [None], [None] * 3
    if n > 1 and np.trace(products) > 0:
        axes, found = kernels.principal_of(products / (n - 1), 3)
        axis, share = [axes[0].tolist()], [*found.tolist(), None, None][:3]
    own = table_.slice(0, 1).select(["whole", "label"])
    for name, value in (("rows", pa.array([n])), ("axis_1", pa.array(axis, pa.list_(pa.float64()))), *((f"share_{k}", pa.array([v], pa.float64())) for k, v in enumerate(share, 1))):
        own = own.append_column(name, value)
    return own


#: Blocks on a side of a pair of stripes at most, and stripes at least, where there are as many blocks.
STRIPE, STRIPES = 16, 16
#: A squared distance is taken from products where it is over this share of both squared norms; else from differences.
NEAR = 1e-5


def _striped(rows: DataFrame, n: int, block: int) -> tuple[DataFrame, int]:
    """``rows`` (row, label, ..) with ``stripe``, ranges of labels and rows, so that a stripe has few labels; and how many ranges there are."""
    wanted = max(-(-n // (STRIPE * block)), min(-(-n // block), STRIPES), 1)
    dealt = written(rows.repartitionByRange(wanted, "label", "row").withColumn("stripe", F.spark_partition_id()), "stripes")
    return dealt, (dealt.agg(F.max("stripe")).first()[0] or 0) + 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    width = np.unique(whole.value_lengths().to_numpy())
    if len(width) != 1:
        raise ValueError(f"vectors of different lengths: {width.tolist()}")
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def _distances(x: np.ndarray, y: np.ndarray, ours: np.ndarray, theirs: np.ndarray, limits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of rows with rows. ``ours @ theirs`` has the squares but for rounding; ``limits`` (one a row on each side) sum to what it must reach."""
    square = ours @ theirs
    if not square.min(initial=np.inf) > limits[0].max(initial=0) + limits[1].max(initial=0):  # also where it is no number
        rows, columns = np.nonzero(~(square > limits[0][:, None] + limits[1]))
        for at in range(0, len(rows), 1 << 16):
            i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            square[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(square, out=square)


def _sums(left: pa.Table, right: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances, rows counted ``times``: of left rows to the right's runs of one label, and of right rows to the left's runs."""
    x, y = _matrix(left["embedding"]), _matrix(right["embedding"])
    with np.errstate(invalid="ignore", over="ignore"):
        middle = x.mean(0).astype(np.float32).astype(float)  # so that its difference to a float is exact
        middle[~np.isfinite(middle)] = 0
        u, v = x - middle, y - middle
        of_x, of_y = (u * u).sum(1), (v * v).sum(1)
        ours = np.column_stack((-2 * u, of_x, np.ones(len(u))))
        theirs = np.ascontiguousarray(np.column_stack((v, np.ones(len(v)), of_y)).T)
        w_x, w_y = (t["times"].to_numpy().astype(float) for t in (left, right))
        runs = [_runs(t["label"]) for t in (left, right)]
        to_right, to_left = np.zeros((len(x), len(runs[1]))), np.zeros((len(y), len(runs[0])))
        for i in range(0, len(x), block):
            for j in range(0, len(y), block):
                a, b = slice(i, i + block), slice(j, j + block)
                d = _distances(x[a], y[b], ours[a], theirs[:, b], (NEAR * of_x[a], NEAR * of_y[b]))
                for k, first, end in _within(runs[1], j, j + block):
                    to_right[a, k] += d[:, first - j : end - j] @ w_y[first:end]
                for k, first, end in _within(runs[0], i, i + block):
                    to_left[b, k] += w_x[first:end] @ d[first - i : end - i]
    return to_right, to_left


def _runs(labels: pa.ChunkedArray) -> list[tuple[int, int]]:
    """First row and end of each run of one label, of rows sorted by label."""
    own = np.array(labels.to_pylist())
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return list(zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True))


def _within(runs: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
    at = bisect.bisect_right(runs, start, key=lambda r: r[1])
    found = []
    while at < len(runs) and runs[at][0] < end:
        found.append((at, max(start, runs[at][0]), min(end, runs[at][1])))
        at += 1
    return found


def _silhouettes(rows: DataFrame, n: int, block: int) -> DataFrame:
    """``row, label, times, silhouette`` of all ``rows`` (row, label, embedding, times), from distances of all rows to all.

    Each pair of stripes is one group, asked once for both sides; a task holds two stripes and a block of distances.
    """
    kind = rows.schema["label"].dataType.simpleString()
    dealt, stripes = _striped(rows, n, block)
    last = F.lit(stripes - 1)
    ours = dealt.select("*", F.col("stripe").alias("a"), F.explode(F.sequence("stripe", last)).alias("b"))
    theirs = dealt.select("*", F.col("stripe").alias("b"), F.explode(F.sequence(F.lit(0), F.col("stripe"))).alias("a"))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.schema.field("label").type
        if not len(left) or not len(right):
            return pa.table({"row": pa.array([], pa.int64()), "label": pa.array([], own), "times": pa.array([], pa.int64()), "other": pa.array([], own), "total": pa.array([], pa.float64())})
        alone = left["stripe"][0] == right["stripe"][0]
        left, right = left.sort_by([("label", "ascending"), ("row", "ascending")]), right.sort_by([("label", "ascending"), ("row", "ascending")])
        found = []
        for these, others, totals in zip((left, right)[: 1 if alone else 2], (right, left), _sums(left, right, block), strict=False):
            kinds = others["label"].take(pa.array([first for first, _ in _runs(others["label"])]))
            for k, other in enumerate(kinds):
                found.append(pa.table({"row": these["row"], "label": these["label"], "times": these["times"], "other": pa.repeat(other, len(these)), "total": totals[:, k]}))
        return pa.concat_tables(found)

    pairs = ours.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInArrow(sums, f"row long, label {kind}, times long, other {kind}, total double")
    sizes = rows.groupBy(F.col("label").alias("other")).agg(F.sum("times").alias("size"))
    totals = pairs.groupBy("row", "label", "times", "other").agg(F.sum("total").alias("total")).join(sizes, "other")
    own = F.col("other") == F.col("label")
    each = totals.groupBy("row", "label", "times").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("outside"),
    )
    value = (F.col("outside") - F.col("inside")) / F.greatest("outside", "inside", F.lit(kernels.EPS))
    return each.select("row", "label", "times", F.when((F.col("size") > 1) & F.col("outside").isNotNull(), value).otherwise(0.0).alias("silhouette"))


@query()
def latent_structure(spark, sf_dir, block: int = 1_000):
    """Per embedding label and over all rows (``whole``): first axis, variance shares, how well labels separate."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "embedding").where("label IS NOT NULL AND embedding IS NOT NULL")
    kind = vectors.schema["label"].dataType.simpleString()
    axes = _moments(vectors, kind).groupBy("whole", "label").applyInArrow(
        _axes, f"whole boolean, label {kind}, rows long, axis_1 array<double>, share_1 double, share_2 double, share_3 double"
    )
    # equal vectors of a label have one silhouette
    rows = written(vectors.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("times")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    single = _silhouettes(rows, rows.count(), block)
    mean = F.sum(F.col("silhouette") * F.col("times")) / F.sum("times")
    value = single.rollup("label").agg(mean.alias("silhouette")).select(F.col("label").alias("of"), "silhouette")
    return axes.join(value, F.col("label").eqNullSafe(F.col("of"))).drop("of")


# Sources and sinks -------------------------------------------------------------------------------------------------


@query(o.sql("c AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+ [0-9]+') AS lines FROM documents)", "pairs AS (SELECT doc_id, unnest(lines) AS line FROM c)", "SELECT doc_id, CAST(split_part(line, ' ', 1) AS BIGINT) AS source, CAST(split_part(line, ' ', 2) AS BIGINT) AS target FROM pairs WHERE try_cast(split_part(line, ' ', 1) AS BIGINT) IS NOT NULL AND try_cast(split_part(line, ' ', 2) AS BIGINT) IS NOT NULL"))
def edge_list_source(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+ [0-9]+"), F.lit(0))).alias("line"))
    return formats.parse_edges(found, "line", ["doc_id"])


@query(o.sql("SELECT user_id, CAST(sum(CAST(('0x' || substr(sha256(event_id || ':' || props), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest, count(*) AS n FROM events GROUP BY user_id"))
def manifest_digests(spark, sf_dir):
    """A digest of each user's rows that does not hang on their order: the sum of the rows' own, combined before the exchange."""
    own = F.conv(F.substring(F.sha2(F.concat_ws(":", "event_id", "props"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(own).cast("string").alias("digest"), F.count(F.lit(1)).alias("n"))


@query(o.sql("SELECT CAST(ts AS DATE) AS run_date, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 90) AS warnings FROM events GROUP BY 1"))
def snapshot_index(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run_date")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 90).alias("warnings"))


@query(o.sql("SELECT event_type, count(*) AS n, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 3) AS total FROM events GROUP BY event_type"))
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(k), 3).alias("total"))


@query(o.sql("c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)", "SELECT conv_id, count(*) AS turns, count(*) FILTER (contains(t, 'the ')) AS with_the, count(*) FILTER (regexp_matches(t, '[0-9]')) AS with_digits FROM c GROUP BY conv_id"))
def text_checks(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(low.contains("the ")).alias("with_the"), F.count_if(low.rlike("[0-9]")).alias("with_digits"))
