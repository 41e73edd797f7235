"""Registries, rule tables, sliding baselines, offsets and recoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import coupling, series
from lattica.sources.panels import by


def sliding_baselines(frame: DataFrame, x: str, window: int, cv_limit: float = 0.15, slope_limit: float = 0.01) -> DataFrame:
    """Every full window by its end, ranked by variation plus relative steepness, and whether both pass."""
    w = by("uid").rowsBetween(1 - window, 0)
    mean = F.avg(x).over(w)
    slid = frame.withColumns({
        "k": F.count(F.lit(1)).over(w),
        "cv": F.round(F.try_divide(F.stddev_samp(x).over(w), mean), 9),
        "steepness": F.round(F.try_divide(F.abs(F.regr_slope(x, "rn").over(w)), mean), 9),
    }).where(F.col("k") == window)
    scored = slid.withColumn("score", F.round(F.col("cv") + F.col("steepness"), 9))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("score", "t")).cast("long")
    return scored.withColumn("rank", rank).withColumn("valid", (F.col("cv") < cv_limit) & (F.col("steepness") < slope_limit))


def trailing_slope(frame: DataFrame, x: str, window: int) -> DataFrame:
    """Slope over the ``window`` rows before each; zero where they do not vary, null before there are that many."""
    w = by("uid").rowsBetween(-window, -1)
    full = F.count(F.lit(1)).over(w) == window
    return frame.withColumn("slope", F.when(full, F.when(F.stddev_pop(x).over(w) < 1e-15, 0.0).otherwise(F.regr_slope(x, "rn").over(w))))


def by_offset(frame: DataFrame, offset: Column, x: str, digits: int) -> DataFrame:
    """Means far before, shortly before and after an event."""
    near = frame.withColumn("_o", offset).where("_o >= -90 AND _o < 30")
    part = F.when(F.col("_o") < -30, "far").when(F.col("_o") < 0, "near").otherwise("after")
    return near.groupBy("uid", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), digits).alias("mean"))


def recovery(frame: DataFrame) -> DataFrame:
    """Runs of ``flag``, the longest, returns from it, and whether the first run began before the series did."""
    found = series.runs(frame, F.col("flag"))
    first = frame.groupBy("uid").agg(F.min("t").alias("first"))
    return found.join(first, "uid").groupBy("uid").agg(
        F.count_if("flag").alias("above_runs"), F.max(F.when(F.col("flag"), F.col("length"))).alias("longest"), F.count_if(~F.col("flag")).alias("recoveries"),
        F.bool_or(F.col("flag") & (F.col("start") == F.col("first"))).alias("left_censored"),
    )


def registry_cells(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """The panel's cells of each named universe; the registry is a stated small table."""
    bridge = registry.select("name", "level", F.explode("assets").alias("asset"))
    return panel.join(F.broadcast(bridge), "asset")


def pair_rules(returns: DataFrame, roles: DataFrame, limit: float = 0.05) -> DataFrame:
    """Each pair's correlation and the first rule that its members' roles meet."""
    c = coupling.pairs(returns).groupBy("uid", "a", "b").agg(F.round(coupling.safe_corr("ra", "rb"), 6).alias("corr"))
    role = lambda x: F.broadcast(roles.select(F.col("asset").alias(x), F.col("role").alias(f"role_{x}")))
    joined = c.join(role("a"), "a").join(role("b"), "b")
    hubs, mixed_ = (F.col("role_a") == "hub") & (F.col("role_b") == "hub"), F.col("role_a") != F.col("role_b")
    rule = (
        F.when(hubs & (F.col("corr") > limit), "hubs_lock").when(hubs, "hubs_apart").when(mixed_ & (F.col("corr") > limit), "transmission")
        .when(mixed_ & (F.col("corr") < -limit), "substitution").when(F.col("corr") > limit, "sources_lock").otherwise("independent")
    )
    return joined.select("uid", "a", "b", "corr", rule.alias("rule"))


def insights(report: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``uid, insight`` for every condition that a report meets."""
    held = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())
    return report.select("uid", F.explode(held).alias("insight"))


def head_correlation(heads: DataFrame) -> DataFrame:
    """Correlation of flattened heads ``(g, i, j, a)``, each pair once."""
    left, right = heads.select("i", "j", F.col("g").alias("a"), F.col("a").alias("xa")), heads.select("i", "j", F.col("g").alias("b"), F.col("a").alias("xb"))
    return left.join(right, ["i", "j"]).where("a < b").groupBy("a", "b").agg(F.round(coupling.safe_corr("xa", "xb"), 6).alias("c"))


#: The eight insights. Each has its kind, the roles that a universe must have (and how many of each), the
#: statuses and the regime that it must be in, bounds that pressure and viscosity must exceed, whether another universe
#: must be critical, its severity, and what raises that: a status, or a bound of pressure or viscosity.
INSIGHTS: list[dict] = [
    {"insight": "havens_coupled", "kind": "anomaly", "roles": {"safe_haven": 1}, "statuses": ["CRITICAL", "PRESSURIZED"], "severity": "medium", "raised": "high", "raise_status": "CRITICAL"},
    {"insight": "bellwethers_locked", "kind": "structural", "roles": {"bellwether": 2}, "statuses": ["CRITICAL", "PRESSURIZED"], "severity": "high"},
    {"insight": "contagion_channels", "kind": "contagion", "roles": {"contagion": 1}, "statuses": ["CRITICAL", "PRESSURIZED"], "severity": "medium", "raised": "high", "raise_pressure": 1.2},
    {"insight": "styles_converge", "kind": "anomaly", "roles": {"growth": 1, "defensive": 1}, "statuses": ["CRITICAL", "PRESSURIZED"], "severity": "medium"},
    {"insight": "rigid_persists", "kind": "regime", "roles": {}, "regime": "rigid", "viscosity": 100.0, "severity": "medium", "raised": "high", "raise_viscosity": 500.0},
    {"insight": "calm_beside_critical", "kind": "layer", "roles": {}, "statuses": ["HEALTHY"], "elsewhere": True, "severity": "medium"},
    {"insight": "fear_stays_low", "kind": "warning", "roles": {"fear_gauge": 1}, "statuses": ["HEALTHY"], "pressure": 0.7, "severity": "low"},
    {"insight": "commodities_follow_macro", "kind": "structural", "roles": {"commodity": 1, "macro_driver": 1}, "statuses": ["CRITICAL", "PRESSURIZED"], "severity": "medium"},
]


def _rule(rule: dict) -> Column:
    def value(name: str, kind: str) -> Column:
        return F.lit(rule.get(name)).cast(kind).alias(name)

    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).cast("long").alias("least")) for r, n in rule["roles"].items()]) if rule["roles"] else F.array().cast("array<struct<role:string,least:bigint>>")
    statuses = F.array(*map(F.lit, rule["statuses"])) if rule.get("statuses") else F.lit(None).cast("array<string>")
    texts = [value(n, "string") for n in ("insight", "kind", "regime", "severity", "raised", "raise_status")]
    bounds = [value(n, "double") for n in ("pressure", "viscosity", "raise_pressure", "raise_viscosity")]
    return F.struct(*texts, *bounds, F.lit(bool(rule.get("elsewhere"))).alias("elsewhere"), roles.alias("roles"), statuses.alias("statuses"))


def role_insights(reports: DataFrame, members: DataFrame, rules: list[dict] = INSIGHTS) -> DataFrame:
    """``uid, insight, kind, severity, assets``: every rule that a universe meets, with the members in the roles it names.

    ``reports`` has ``uid, status, regime, pressure, viscosity``, ``members`` ``uid, asset, role``. Rules are data: a list
    that goes along with every report. What is gathered of a universe is a row a role, with its members' names.
    """
    by_role = members.groupBy("uid", "role").agg(F.collect_set("asset").alias("assets"))
    held = by_role.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("role", "assets"))).alias("held"))
    critical = reports.where("status = 'CRITICAL'").agg(F.count(F.lit(1)).alias("all_critical"))  # one row
    whole = reports.join(held, "uid", "left").join(F.broadcast(critical))
    each = whole.withColumn("r", F.explode(F.array(*map(_rule, rules))))
    many = lambda x: F.coalesce(F.size(F.try_element_at("held", x["role"])), F.lit(0))
    over = lambda bound, c: F.col(f"r.{bound}").isNull() | F.coalesce(F.col(c) > F.col(f"r.{bound}"), F.lit(False))
    others = F.col("all_critical") - (F.col("status") == "CRITICAL").cast("int")
    met = (
        F.forall("r.roles", lambda x: F.greatest(many(x), F.lit(0)) >= x["least"])
        & (F.col("r.statuses").isNull() | F.array_contains("r.statuses", F.col("status")))
        & (F.col("r.regime").isNull() | F.coalesce(F.col("regime") == F.col("r.regime"), F.lit(False)))
        & over("pressure", "pressure") & over("viscosity", "viscosity") & (~F.col("r.elsewhere") | (others > 0))
    )
    raised = (
        F.coalesce(F.col("status") == F.col("r.raise_status"), F.lit(False))
        | F.coalesce(F.col("pressure") > F.col("r.raise_pressure"), F.lit(False))
        | F.coalesce(F.col("viscosity") > F.col("r.raise_viscosity"), F.lit(False))
    )
    named = F.array_sort(F.flatten(F.transform("r.roles", lambda x: F.try_element_at("held", x["role"]))))
    return each.where(met).select("uid", "r.insight", "r.kind", F.when(raised, F.col("r.raised")).otherwise(F.col("r.severity")).alias("severity"), named.alias("assets"))
