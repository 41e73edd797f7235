"""Queries on matrices of conversations, insights by roles, even folds, and the leading axes of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import attention, evaluate, events, fits, network, rules, series, state, studies
from lattica.plans import oracle as o
from lattica.plans.catalog import SCALED, _distances, _oh_state, all_returns, query, r6
from lattica.plans.evaluation import ATTENTION, _axes, _moments
from lattica.plans.monitoring import REPORT, SPIKES
from lattica.runtime import table, written

# Matrices of conversations ---------------------------------------------------------------------------------------------

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_kinds = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
for _letter, _pattern in (*attention.KINDS.items(), ("O", "[^VCDBM]")):
    _kinds = f"regexp_replace({_kinds}, '{_pattern}', '{_letter}', 'g')"
TEXT_MATRICES = f"""kinds AS (SELECT conv_id AS g, {_kinds} AS s FROM conversations
), steps AS (SELECT g, strpos('{attention.LETTERS}', s[i:i]) - 1 AS i, strpos('{attention.LETTERS}', s[i + 1:i + 1]) - 1 AS j FROM (SELECT g, s, unnest(range(1, length(s))) AS i FROM kinds)
), counts AS (SELECT g, i, j, count(*) AS a FROM steps GROUP BY ALL
), matrices AS (
  SELECT c.g, p.i, q.j, CAST(coalesce(n.a, 0) AS DOUBLE) AS a FROM (SELECT DISTINCT g FROM kinds) c, range({len(attention.LETTERS)}) p(i), range({len(attention.LETTERS)}) q(j)
  LEFT JOIN counts n ON n.g IS NOT DISTINCT FROM c.g AND n.i = p.i AND n.j = q.j)"""
FAMILY = "ps AS (" + ATTENTION.split("), ps AS (")[1]


@query(o.sql(TEXT_MATRICES, FAMILY, "SELECT * FROM family"))
def conversation_attention(spark, sf_dir):
    """The entropy family of every conversation's matrix of character kinds."""
    return attention.entropy_family(attention.as_cells(attention.text_matrices(table(spark, sf_dir, "conversations")).drop("head")))


WAYS = ["sum", "row", "max", "none"]
HEADED = TEXT_MATRICES.replace("SELECT conv_id AS g,", "SELECT conv_id AS g, coalesce(turn, 0) % 8 AS head,").replace("), matrices AS (", "), unused AS (")


@query(o.sql(HEADED, "sizes AS (SELECT g, count(DISTINCT head) AS heads FROM kinds GROUP BY g)",
             f"summed AS (SELECT c.g, p.i, q.j, coalesce(n.a, 0) / c.heads AS a FROM sizes c, range({len(attention.LETTERS)}) p(i), range({len(attention.LETTERS)}) q(j) LEFT JOIN counts n ON n.g IS NOT DISTINCT FROM c.g AND n.i = p.i AND n.j = q.j)",
             """ways AS (
  SELECT g, 'none' AS how, a FROM summed UNION ALL SELECT g, 'sum', coalesce(a / nullif(sum(a) OVER (PARTITION BY g), 0), 0) FROM summed
  UNION ALL SELECT g, 'row', coalesce(a / nullif(sum(a) OVER (PARTITION BY g, i), 0), 0) FROM summed UNION ALL SELECT g, 'max', coalesce(a / nullif(max(a) OVER (PARTITION BY g), 0), 0) FROM summed)""",
             "SELECT g, how, round(sum(a), 6) AS total, round(max(a), 6) AS largest, round(sum(a * a), 6) AS squares FROM ways GROUP BY g, how"))
def conversation_normalised(spark, sf_dir):
    """The mean matrix of a conversation's heads, normalised four ways: sum, largest cell and sum of squares."""
    heads = attention.as_cells(attention.text_matrices(table(spark, sf_dir, "conversations"), heads=attention.HEADS))
    mean = written(attention.mean_of_heads(heads), "mean-heads")
    out: DataFrame | None = None
    for how in WAYS:
        own = attention.normalised(mean, how).groupBy("g").agg(F.round(F.sum("a"), 6).alias("total"), F.round(F.max("a"), 6).alias("largest"), F.round(F.sum(F.col("a") * F.col("a")), 6).alias("squares")).withColumn("how", F.lit(how))
        out = own if out is None else out.unionByName(own)
    return out


#: Parts of rounded features lie half-way between two rounded ones at times; this moves them off.
OFF_TIES = 1.3e-9


def _preset_sql(ws: dict[str, float]) -> str:
    whole = sum(map(abs, ws.values()))
    value = {"xi": "(1 - xi)", "omega": "(-omega)"}
    parts = {k: f"{value.get(k, k)} * {w / whole!r}::DOUBLE" for k, w in ws.items()}
    return f"round({' + '.join(parts.values())} + {OFF_TIES}::DOUBLE, 6) AS score, " + ", ".join(f"round({v} + {OFF_TIES}::DOUBLE, 6) AS part_{k}" for k, v in parts.items())


@query(o.sql(TEXT_MATRICES, FAMILY, "rated AS (SELECT *, round(ln(1 + xi), 6) AS rscore FROM family)", " UNION ALL ".join(f"SELECT g, '{p}' AS preset, {_preset_sql(ws)} FROM rated" for p, ws in attention.PRESETS.items())))
def conversation_presets(spark, sf_dir):
    """Every conversation's composite score under each weighting, with the features' parts."""
    cells = attention.as_cells(attention.text_matrices(table(spark, sf_dir, "conversations")).drop("head"))
    rated = attention.entropy_family(cells).withColumn("rscore", F.round(F.log1p("xi"), 6))
    found = attention.preset_scores(rated)
    return found.select("g", "preset", *(F.round(F.col(c) + OFF_TIES, 6).alias(c) for c in found.columns if c not in ("g", "preset")))


@query()
def conversation_spectra(spark, sf_dir):
    """Gap, five and escape beyond the random edge of every conversation, its turns dealt over heads."""
    found = attention.spectra(attention.text_matrices(table(spark, sf_dir, "conversations"), heads=attention.HEADS))
    return found.select(F.col("g").alias("conv_id"), "heads", "escaped", *r6("phi", *attention.SPECTRUM))


# Insights by roles -----------------------------------------------------------------------------------------------------

MEMBERS = [
    ("AFRICA", "commodity"), ("AMERICA", "bellwether"), ("AMERICA", "fear_gauge"), ("ASIA", "bellwether"), ("ASIA", "growth"),
    ("EUROPE", "defensive"), ("EUROPE", "safe_haven"), ("MIDDLE EAST", "contagion"), ("MIDDLE EAST", "macro_driver"),
]
#: Viscosity stands for the longest rigid run here, so its bounds are in rows.
RULES = [r | ({"viscosity": 10.0, "raise_viscosity": 50.0} if "viscosity" in r else {}) for r in rules.INSIGHTS]


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(list(x)) if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE"


_fields = ("insight", "kind", "statuses", "regime", "pressure", "viscosity", "severity", "raised", "raise_status", "raise_pressure", "raise_viscosity")
INSIGHT_SQL = (
    f"rule({', '.join(_fields)}, elsewhere) AS (VALUES " + ", ".join("(" + ", ".join([*(_literal(r.get(f)) for f in _fields), _literal(bool(r.get("elsewhere")))]) + ")" for r in RULES) + ")",
    "required(insight, role, least) AS (VALUES " + ", ".join(f"('{r['insight']}', '{k}', {n})" for r in RULES for k, n in r["roles"].items()) + ")",
    "roles(asset, role) AS (VALUES " + ", ".join(map(str, MEMBERS)) + ")",
    "members AS (SELECT DISTINCT uid, asset, role FROM rets JOIN roles USING (asset))",
    "held AS (SELECT uid, role, count(*) AS n FROM members GROUP BY uid, role)",
    """met AS (
  SELECT s.uid, s.status, s.oh_max, s.tau_max, r.* FROM statuses s, rule r
  WHERE (r.statuses IS NULL OR list_contains(r.statuses, s.status)) AND (r.regime IS NULL OR s.regime = r.regime) AND (r.pressure IS NULL OR s.oh_max > r.pressure) AND (r.viscosity IS NULL OR s.tau_max > r.viscosity)
    AND (NOT r.elsewhere OR EXISTS (SELECT 1 FROM statuses z WHERE z.uid <> s.uid AND z.status = 'CRITICAL'))
    AND NOT EXISTS (SELECT 1 FROM required q WHERE q.insight = r.insight AND coalesce((SELECT n FROM held h WHERE h.uid = s.uid AND h.role = q.role), 0) < q.least))""",
    """SELECT uid, insight, kind, CASE WHEN status = raise_status OR oh_max > raise_pressure OR tau_max > raise_viscosity THEN raised ELSE severity END AS severity,
  coalesce((SELECT string_agg(asset, ',' ORDER BY asset) FROM members b JOIN required q ON q.role = b.role WHERE b.uid = met.uid AND q.insight = met.insight), '') AS assets FROM met""",
)


@query(o.sql(*o.FULL, SPIKES, REPORT, *INSIGHT_SQL, recursive=True))
def role_insights(spark, sf_dir):
    """What a universe's state means for the roles of its members, by eight rules."""
    report = events.universe_report(state.universe_state(spark, sf_dir))
    reports = report.select("uid", "status", "regime", F.col("oh_max").alias("pressure"), F.col("tau_max").cast("double").alias("viscosity"))
    roles = spark.createDataFrame(MEMBERS, "asset string, role string")
    members = all_returns(spark, sf_dir).select("uid", "asset").distinct().join(F.broadcast(roles), "asset")  # a stated few
    return rules.role_insights(reports, members, RULES).withColumn("assets", F.array_join("assets", ","))


# Signature on circuits -------------------------------------------------------------------------------------------------

CIRCUITS = (
    SCALED,
    "turned AS (SELECT uid, t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs((a * da + b * db + c * dc) / ((sqrt(a * a + b * b + c * c) + 1e-12) * (sqrt(da * da + db * db + dc * dc) + 1e-12))))) AS divergence FROM moved)",
    "circuits AS (SELECT e.uid, e.t, CAST(e.n - v.n + 1 AS DOUBLE) AS h1 FROM (SELECT uid, t, count(*) AS n FROM graph GROUP BY ALL) e JOIN (SELECT uid, t, count(DISTINCT i) AS n FROM around GROUP BY ALL) v USING (uid, t))",
    "circled AS (SELECT s.*, h1, round(divergence, 9) AS d FROM state s JOIN circuits USING (uid, t) JOIN turned USING (uid, t))",
    f"""tops AS (SELECT uid, greatest(quantile_cont(h1, 0.95), 1.0::DOUBLE) AS h95, quantile_cont(eta, 0.75) AS e75, quantile_cont(d, 0.75) AS d75 FROM circled WHERE {o.CALM} GROUP BY uid
), paths AS (SELECT c.*, h1 / h95 AS xi, e75, d75, coalesce(phi - lag(phi) OVER (PARTITION BY uid ORDER BY t), 0) AS dphi FROM circled c JOIN tops USING (uid)
), critical AS (SELECT uid, greatest(quantile_cont(xi, 0.99), max(xi)) * 1.02::DOUBLE AS xi_c FROM paths WHERE {o.CALM} GROUP BY uid)""",
)
SIGNATURE = """signs AS (SELECT uid, t, oh > oh_pre AS c1, phi > phi_c AS c2, dphi > 0 AS c3, eta > e75 AS c4, xi < 1 AS c5, d < d75 AS c6 FROM paths
), flagged AS (SELECT *, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AS flag FROM signs)"""
STUCK = """held0 AS (SELECT uid, max(length) AS tau FROM runs WHERE flag = 'rigid' GROUP BY uid
), stuck AS (
  SELECT uid, coalesce(avg(eta) FILTER (regime = 'rigid'), 0) AS e, coalesce(avg(xi) FILTER (regime = 'rigid'), 0) AS x, greatest(CASE WHEN count(*) FILTER (xi > 0) > 5 THEN quantile_cont(xi, 0.05) FILTER (xi > 0) ELSE 1e-12 END, 1e-12) AS floor FROM paths GROUP BY uid)"""


def on_circuits(spark, sf_dir) -> DataFrame:
    """The state with the circuits of each window's neighbour graph (edges less nodes, and one) as its ways out, their ratio
    to quiet ones and its critical value, and the phase divergence."""
    edges = network.nearest_neighbours(_distances(spark, sf_dir), ["uid", "t"])
    nodes = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("u", "v")))))  # of one window's graph
    circuits = edges.groupBy("uid", "t").agg((F.count(F.lit(1)) - nodes + 1).cast("double").alias("h1_count"))
    joined = state.universe_state(spark, sf_dir).join(circuits, ["uid", "t"])
    diverged = series.phase_divergence(joined, ["oh", "eta", "vol"]).withColumn("divergence", F.round("divergence", 9))
    return studies.cycle_ratio(diverged)


@query(o.sql(*o.FULL, *CIRCUITS, "SELECT uid, t, h1 AS circuits, round(xi, 6) AS xi, round(xi_c, 6) AS xi_c FROM paths JOIN critical USING (uid)", recursive=True))
def circuit_ratio(spark, sf_dir):
    """Ways out relative to quiet times, and the ratio's critical value."""
    return on_circuits(spark, sf_dir).select("uid", "t", F.col("h1_count").alias("circuits"), *r6("xi", "xi_c"))


@query(o.sql(*o.FULL, *CIRCUITS, SIGNATURE, o.RUNS, "SELECT uid, " + ", ".join(f"round(avg(CAST({a} AS INTEGER)), 6) AS {b}" for a, b in [("flag", "tau"), *((f"c{i}", f"c{i}") for i in range(1, 7))]) + ", min(t) FILTER (flag) AS onset, coalesce((SELECT max(length) FROM runs r WHERE r.flag AND r.uid = flagged.uid), 0) AS longest FROM flagged GROUP BY uid", recursive=True))
def circuit_signature(spark, sf_dir):
    """How often the six conditions of pressure hold at once, by circuits."""
    return state.pressure_signature(on_circuits(spark, sf_dir))


@query(o.sql(*o.FULL, *CIRCUITS, "flagged AS (SELECT uid, t, regime AS flag FROM state)", o.RUNS, STUCK, "SELECT s.uid, round(coalesce(tau, 0) * e / (x + floor), 6) AS viscosity FROM stuck s LEFT JOIN held0 USING (uid)", recursive=True))
def circuit_viscosity(spark, sf_dir):
    """The longest rigid run times rigidity over the ways out that are left."""
    return studies.viscosity(on_circuits(spark, sf_dir)).select("uid", *r6("viscosity"))


# All universes at once -------------------------------------------------------------------------------------------------


@query(o.sql(*o.FULL, SPIKES, REPORT, """ats AS (SELECT uid, max(oh) FILTER (rn = n) AS now, max(oh) FILTER (rn = n - 6) AS week FROM ohs GROUP BY uid
), ways AS (SELECT uid, CASE WHEN round(now - week, 6) > 0.05 THEN 1 WHEN round(now - week, 6) < -0.05 THEN -1 ELSE 0 END AS way FROM ats
), sums AS (SELECT count(*) FILTER (way = 1) AS rising, count(*) FILTER (way = -1) AS falling FROM ways
), kinds AS (SELECT count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status IN ('CRITICAL', 'PRESSURIZED')) AS alarmed, count(*) AS universes FROM statuses)""",
             "SELECT rising, falling, CASE WHEN rising > falling + 2 THEN 'deteriorating' WHEN falling > rising + 2 THEN 'improving' ELSE 'mixed' END AS trend, critical, alarmed, universes, CASE WHEN alarmed > 0 AND 2 * critical >= universes THEN 'global' WHEN alarmed > 0 THEN 'regional' ELSE 'none' END AS contagion FROM sums, kinds WHERE universes > 0", recursive=True))
def global_trend(spark, sf_dir):
    """Whether more universes rise than fall, and how far alarms reach."""
    return events.global_trend(events.universe_report(state.universe_state(spark, sf_dir)), events.recent_trend(_oh_state(spark, sf_dir)))


EXTREMES = [("2024-01-09", "2024-01-14"), ("2024-01-13", "2024-01-16"), ("2024-01-20", "2024-01-21")]


@query(o.sql("days AS (SELECT CAST(ts AS DATE) AS t, round(avg(value), 6) AS oh, round(stddev_pop(value), 6) AS eta FROM events GROUP BY 1)",
             "periods(low, high) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in EXTREMES) + ")",
             "marked AS (SELECT d.*, EXISTS (SELECT 1 FROM periods p WHERE d.t BETWEEN p.low AND p.high) AS extreme FROM days d)",
             "long AS (SELECT extreme, unnest(['oh', 'eta']) AS observable, unnest([oh, eta]) AS v FROM marked)",
             "SELECT observable, count(*) FILTER (NOT extreme) AS n_normal, count(*) FILTER (extreme) AS n_extreme, round(avg(v) FILTER (NOT extreme), 6) AS normal, round(avg(v) FILTER (extreme), 6) AS extreme, round(avg(v) FILTER (extreme) - avg(v) FILTER (NOT extreme), 6) AS delta FROM long GROUP BY observable"))
def normal_and_extreme(spark, sf_dir):
    """Days in any extreme period against all others."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t")).agg(F.round(F.avg("value"), 6).alias("oh"), F.round(F.stddev_pop("value"), 6).alias("eta"))
    periods = spark.createDataFrame(EXTREMES, "low string, high string").select(*(F.to_date(c).alias(c) for c in ("low", "high")))
    return events.semi_anti(days, periods, ["oh", "eta"])


# Even folds ------------------------------------------------------------------------------------------------------------


@query(o.sql(*o.FULL, "SELECT uid, t, regime, CAST((row_number() OVER (PARTITION BY regime ORDER BY sha256(uid || '|' || CAST(t AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM state", recursive=True))
def stratified_folds(spark, sf_dir):
    """Five folds of the state's rows, every regime spread evenly."""
    frame = state.universe_state(spark, sf_dir).select("uid", "t", "regime")
    return evaluate.stratified_folds(frame, "regime", F.sha2(F.concat_ws("|", "uid", F.col("t").cast("string")), 256), 5)


@query()
def stratified_forest(spark, sf_dir, folds: int = 5):
    """Forests of stated sizes on even folds: ``trees, depth, fold, rows, rigid, accuracy, f1``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ["mean_corr", "eta", "vol", "oh"]
    frame = state.universe_state(spark, sf_dir).select("uid", "t", *names, (F.col("regime") == "rigid").cast("double").alias("label"))
    dealt = evaluate.stratified_folds(frame, "label", F.sha2(F.concat_ws("|", "uid", F.col("t").cast("string")), 256), folds)
    rows = written(VectorAssembler(inputCols=names, outputCol="features").transform(dealt), "stratified")
    out: DataFrame | None = None
    for trees, depth in ((10, 3), (20, 5)):
        for k in range(folds):
            training = rows.where(F.col("fold") != k)
            if not training.head(1):
                continue
            told = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1).fit(training).transform(rows.where(F.col("fold") == k))
            hit, said, true = (F.sum(c.cast("double")) for c in ((F.col("prediction") == 1) & (F.col("label") == 1), F.col("prediction") == 1, F.col("label") == 1))
            own = told.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("rigid"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.coalesce(F.try_divide(2 * hit, said + true), F.lit(0.0)), 6).alias("f1"))
            own = own.select(F.lit(trees).alias("trees"), F.lit(depth).alias("depth"), F.lit(k).alias("fold"), "*")
            out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "trees int, depth int, fold int, rows long, rigid long, accuracy double, f1 double")


# Leading axes of vectors -----------------------------------------------------------------------------------------------


def leading_axes(vectors: DataFrame) -> DataFrame:
    """``whole, label, rows, axis_1`` and shares, from moments added up over tasks."""
    kind = vectors.schema["label"].dataType.simpleString()
    return _moments(vectors, kind).groupBy("whole", "label").applyInArrow(_axes, f"whole boolean, label {kind}, rows long, axis_1 array<double>, share_1 double, share_2 double, share_3 double")


def axis_pairs(axes: DataFrame, least_rows: int = 50) -> DataFrame:
    """``a, b, cosine``: how alike the leading axes of two labels are, whichever way they point; a row a pair of labels."""
    own = axes.where((~F.col("whole")) & (F.col("rows") >= least_rows) & F.col("axis_1").isNotNull())
    left, right = (own.select("whole", F.col("label").alias(n), F.col("axis_1").alias(f"x{n}")) for n in "ab")
    dot = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)  # axes are of length one
    return left.join(right, "whole").where("a < b").select("a", "b", F.abs(dot).alias("cosine"))


def explained(rows: DataFrame, target: str, observables: list[str]) -> tuple[float, dict[str, float]]:
    """R² of ``target`` on all observables, and its correlation with each: sums of products over rows, solved once."""
    names = [*observables, target]

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = fits.design(batch, names)
        return (x.T @ x).reshape(1, -1)

    centre = {n: v for n, v in zip(names, rows.agg(*(F.avg(n) for n in names)).first(), strict=True)}
    moved = rows.select(*((F.col(n) - F.lit(centre[n])).alias(n) for n in names))
    whole = fits._summed(moved, sums, 1, (len(names) + 1) ** 2).reshape(len(names) + 1, -1)
    cov, cross, total = whole[1:-1, 1:-1], whole[1:-1, -1], whole[-1, -1]
    weights = np.linalg.lstsq(cov, cross, rcond=1e-12)[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        each = np.nan_to_num(cross / np.sqrt(np.diag(cov) * total))
    return (float(weights @ cross / total) if total > 0 else 0.0), dict(zip(observables, map(float, each), strict=True))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")).where("label IS NOT NULL AND embedding IS NOT NULL")


@query()
def axis_cosines(spark, sf_dir):
    """Stability of the leading direction over labels: every pair's cosine, beside the mean and the least of all."""
    pairs = axis_pairs(leading_axes(_vectors(spark, sf_dir)))
    one = pairs.agg(F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.round(F.min("cosine"), 6).alias("least_cosine"))  # one row
    return pairs.withColumn("cosine", F.round("cosine", 6)).join(F.broadcast(one))


@query()
def axis_explained(spark, sf_dir):
    """The leading axis against simple observables of the vectors: correlation with each, and R² on all of them."""
    vectors = _vectors(spark, sf_dir)
    first = leading_axes(vectors).where("whole AND axis_1 IS NOT NULL").select("axis_1").first()  # as many numbers as a vector has
    schema = "observable string, r double, r_squared double"
    if first is None:
        return spark.createDataFrame([], schema)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    axis = F.array(*[F.lit(float(x)) for x in first["axis_1"]])
    seen = vectors.select(
        total(F.zip_with("embedding", axis, lambda x, y: x * y)).alias("score"), F.array_max("embedding").alias("largest"), F.array_min("embedding").alias("smallest"),
        total("embedding").alias("sum"), total(F.transform("embedding", lambda x: x * x * x * x)).alias("fourth"), F.element_at("embedding", 1).alias("first"),
    )
    r2, each = explained(seen, "score", ["largest", "smallest", "sum", "fourth", "first"])
    return spark.createDataFrame([(k, round(v, 6), round(r2, 6)) for k, v in each.items()], schema)
