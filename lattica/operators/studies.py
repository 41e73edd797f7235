"""Studies on finished states: audits, cohorts, phases, cascades, variants of the attractor's strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.config import HAZARD, STATE
from lattica.functions.kernels import DEVIATION_FLOOR
from lattica.operators import series
from lattica.sources.panels import by

#: Mean and deviation of recurrence over a corpus, where a series has no quiet rows of its own.
CORPUS = {"det": (0.85, 0.10), "lam": (0.90, 0.08), "tt": (5.0, 3.0)}
WEIGHTS = {"det": 0.40, "lam": 0.35, "tt": 0.25}


def concentration(mean_corr: Column, n: int) -> Column:
    """Share of the leading eigenvalue where all pairs are equally coupled."""
    return (1 + (n - 1) * mean_corr) / n


def strength_variants(found: DataFrame, rows: int = 120, least: int = 10) -> DataFrame:
    """Adds ``v0`` to ``v3`` to ``uid, t, det, lam, tt, theta, scr``: the strength as it is, against the corpus, against
    the ``rows`` before, and lifted by the concentration ``scr`` (or by that alone where there is none)."""
    whole, w = Window.partitionBy("uid"), by("uid")
    before, calm = w.rowsBetween(-rows, -1), series.quiet()
    placed = series.numbered(found)
    cap = F.lit(HAZARD.attractor_cap)
    positive = lambda x: F.greatest(x, F.lit(0.0))
    corpus = sum((q * positive((F.col(c) - CORPUS[c][0]) / CORPUS[c][1]) for c, q in WEIGHTS.items()), F.lit(0.0))
    recent = sum((q * positive((F.col(c) - F.avg(c).over(before)) / F.greatest(F.stddev_pop(c).over(before), F.lit(DEVIATION_FLOOR))) for c, q in WEIGHTS.items()), F.lit(0.0))
    judged = F.col("det").isNotNull() & (F.col("rn") > rows) & (F.count("det").over(before) >= least)
    z = positive((F.col("scr") - F.percentile(F.when(calm, F.col("scr")), F.lit(0.5)).over(whole)) / F.greatest(F.stddev_pop(F.when(calm, F.col("scr"))).over(whole), F.lit(DEVIATION_FLOOR)))
    lifted = F.when((F.col("theta") < 0.1) & (F.col("_z") > 1.0), F.least(0.5 * F.col("_z"), cap)).otherwise(F.least(F.col("theta") * (1 + 0.5 * F.col("_z")), cap))
    out = placed.withColumn("_z", z).withColumns({
        "v0": F.col("theta"), "v1": F.when(F.col("det").isNotNull(), F.least(corpus, cap)).otherwise(0.0), "v2": F.when(judged, F.least(recent, cap)).otherwise(0.0), "v3": lifted,
    })
    return out.drop("_z", "rn", "n")


def suppression_audit(frame: DataFrame, horizon: int = 90) -> DataFrame:
    """Per series of ``uid, t, theta, scr, capacity_share``: rows of high concentration on which the strength says nothing,
    how many of them come within ``horizon`` rows of the first damage, and a verdict on their share."""
    whole = Window.partitionBy("uid")
    placed = series.numbered(frame).withColumn("_high", F.percentile("scr", F.lit(0.75)).over(whole))
    hurt = F.min(F.when(F.col("capacity_share") < 0.9, F.col("rn"))).over(whole)
    marked = placed.withColumn("t_s", hurt).withColumn("silent", (F.col("scr") > F.col("_high")) & (F.col("theta") < 0.1))
    near = F.col("silent") & (F.col("rn") < F.col("t_s")) & (F.col("t_s") - F.col("rn") <= horizon)
    summed = marked.groupBy("uid").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("theta") > 0.5, F.col("rn"))).cast("long").alias("t_g"), F.max("t_s").cast("long").alias("t_s"),
        F.count_if("silent").alias("suppressed"), F.count_if(near).alias("before_damage"),
    )
    share = F.col("suppressed") / F.col("rows")
    verdict = F.when(share > 0.20, "SEVERE_SUPPRESSION").when(share > 0.05, "MODERATE_SUPPRESSION").otherwise("MINIMAL")
    return summed.withColumn("share", F.round(share, 6)).withColumn("verdict", verdict)


def phase(theta: Column, capacity_share: Column) -> Column:
    """Where a watched system stands between a first activation and the point of no return."""
    whole = F.when(theta > 0.5, "GEOMETRIC_ACTIVE_NO_DAMAGE").otherwise("QUIESCENT")
    return F.when(capacity_share >= 0.9, whole).when(capacity_share >= 0.5, "STRUCTURAL_ACTIVATION_MILD").when(capacity_share >= 0.0, "STRUCTURAL_ACTIVATION_SEVERE").otherwise("POST_IRREVERSIBILITY")


def cascade(sensed: DataFrame, confirmed: DataFrame, outcome: DataFrame) -> DataFrame:
    """``uid, total_days, cascade_days, sync_ratio``: from the first sensed crossing (``uid, crossing``, any number of
    rows a series) to the last confirmed one and to the outcome (``uid, t``)."""
    first = sensed.groupBy("uid").agg(F.min("crossing").alias("first"))
    last = confirmed.groupBy("uid").agg(F.max("crossing").alias("last"))
    known = outcome.join(first, "uid", "left").join(last, "uid", "left")
    total, between = F.datediff("t", "first"), F.datediff(F.coalesce("last", "first"), "first")
    ratio = F.when(total > 0, F.round(between / total, 6)).when(F.col("first").isNotNull(), 0.0)
    return known.select("uid", F.col("first").alias("first_sensed"), F.coalesce("last", "first").alias("last_confirmed"), total.cast("long").alias("total_days"), between.cast("long").alias("cascade_days"), ratio.alias("sync_ratio"))


def cohort_drift(state: DataFrame, columns: list[str], leading: str) -> DataFrame:
    """Per series: means over all rows and over the last quarter, and how the leading column's mean moves from the first
    quarter to the last (a last quarter that is no whole number of rows takes one more)."""
    placed = series.numbered(state)
    late, first, last = F.col("rn") > F.floor(0.75 * F.col("n")), F.col("rn") <= F.floor(F.col("n") / 4), F.col("rn") > F.col("n") - F.ceil(F.col("n") / 4)
    mean = lambda c, on: F.avg(F.when(on, F.col(c)) if on is not None else F.col(c))
    named = [F.round(mean(c, None), 6).alias(f"mean_{c}") for c in columns] + [F.round(mean(c, late), 6).alias(f"late_{c}") for c in columns]
    return placed.groupBy("uid").agg(*named, F.round(mean(leading, last) - mean(leading, first), 6).alias("drift"))


def coherence(oh: Column, divergence: Column, xi: Column, mean_corr: Column) -> Column:
    """Excess of order over disorder; ``oh`` is scaled to one."""
    return (oh + divergence) / 2 - (xi + (1 - mean_corr)) / 2


def divergence_bucket(value: Column, middle: Column) -> Column:
    """What a divergence means by its ratio to the usual one."""
    ratio = F.when(middle > 0, value / middle).otherwise(value)
    names = ((0.5, "aligned"), (1.0, "coherent"), (1.5, "mild"), (2.5, "moderate"), (4.0, "high"))
    out = F.when(ratio < names[0][0], names[0][1])
    for limit, name in names[1:]:
        out = out.when(ratio < limit, name)
    return out.otherwise("critical")


def moving_features(frame: DataFrame, columns: list[str], rows: int = 10, step: float = 2.0) -> DataFrame:
    """Adds each column's slope per unit of a row's ``step`` and its deviation over ``rows`` rows; what a series' first
    rows lack comes from the next one that has it."""
    w = by("uid")
    full, later = w.rowsBetween(1 - rows, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = frame
    for c in columns:
        made = made.withColumn(f"{c}_slope", (F.col(c) - F.lag(c).over(w)) / step).withColumn(f"{c}_std", F.when(F.count(c).over(full) == rows, F.stddev_samp(c).over(full)))
    return made.withColumns({n: F.first(n, ignorenulls=True).over(later) for c in columns for n in (f"{c}_slope", f"{c}_std")})


#: Means of rounded values lie half-way between two rounded ones at times; this moves them off, one way for all.
OFF_TIES = 1.3e-12


def smoothed_scores(frame: DataFrame, metrics: list[str], rows: list[int], targets: list[str]) -> DataFrame:
    """``uid, metric, rows, target, score, y``: every metric as the mean of ever more rows, against every target; all
    means come from one ordering of the frame, and the settings go along with each row as an array."""
    w = by("uid")
    mean = lambda m, k: F.when(F.count(m).over(w.rowsBetween(1 - k, 0)) == k, F.avg(m).over(w.rowsBetween(1 - k, 0)))
    named = {f"_{m}_{k}": (m, k) for m in metrics for k in rows}
    made = frame.select("uid", *targets, *(mean(m, k).alias(n) for n, (m, k) in named.items()))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("rows"), F.round(F.col(n) + OFF_TIES, 9).alias("score")) for n, (m, k) in named.items()])
    goals = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y")) for t in targets])
    long = made.select("uid", F.explode(each).alias("s"), goals.alias("goals")).select("uid", "s.*", F.explode("goals").alias("t"))
    return long.select("uid", "metric", "rows", "t.target", "score", "t.y").where("score IS NOT NULL AND y IS NOT NULL")


def row_patterns(matrices: DataFrame, floor: float = 1e-10) -> DataFrame:
    """``g, i, k, c``: how alike rows of each square matrix ``g, i, j, a`` are; of matrices under three rows, no row is like another."""
    row, whole = Window.partitionBy("g", "i"), Window.partitionBy("g")
    z = (F.col("a") - F.avg("a").over(row)) / F.greatest(F.stddev_pop("a").over(row), F.lit(floor))
    scaled = matrices.select("g", "i", "j", z.alias("z"), (F.max("i").over(whole) + 1).alias("n"))
    other = scaled.select("g", F.col("i").alias("k"), "j", F.col("z").alias("y"))
    summed = scaled.join(other, ["g", "j"]).where("i < k").groupBy("g", "i", "k", "n").agg(F.sum(F.col("z") * F.col("y")).alias("s"))
    c = F.greatest(F.least(F.col("s") / F.col("n"), F.lit(1.0)), F.lit(-1.0))
    return summed.select("g", "i", "k", F.when(F.col("n") < 3, 0.0).otherwise(c).alias("c"))


def ring_graph(spark: SparkSession, n: int, k: int, percent: int, seed: int = 1) -> DataFrame:
    """``u, v``: a ring of n nodes, each tied to its k next, of which ``percent`` in a hundred ties go elsewhere."""
    ties = spark.range(n * k).select(F.floor(F.col("id") / k).alias("a"), (F.col("id") % k + 1).alias("s"))
    draw = (F.col("a") * 7_919 + F.col("s") * 104_729 + seed * 1_299_709) % 1_000_003
    far = F.when(draw % 100 < percent, (F.col("a") + 1 + draw % (n - 1)) % n).otherwise((F.col("a") + F.col("s")) % n)
    return ties.withColumn("b", far).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def random_graph(spark: SparkSession, n: int, permille: int, seed: int = 1) -> DataFrame:
    """``u, v``: of all pairs of n nodes, about ``permille`` in a thousand."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("u"), (F.col("id") % n).alias("v")).where("u < v")
    return pairs.where((F.col("u") * 7_919 + F.col("v") * 104_729 + seed * 1_299_709) % 1_000_003 % 1_000 < permille)


def growing_graph(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``u, v``: a tree in which each node ties itself to an end of an earlier tie, so that what has ties gets more.

    The end of tie e is node e + 1 or what tie e leads to, by a draw; the lookup is one walk of expected constant
    length, laid out as rounds of joins until no tie is open.
    """
    draw = lambda c: (c * 48_271 + seed * 69_621) % 2_147_483_647
    ties = spark.range(1, n).select(F.col("id").alias("u"), F.col("id").alias("at"))
    found = None
    for _ in range(64):
        # node at takes part in tie at - 1 of the earlier ones: a drawn tie's newer end, or on to its older end
        moved = ties.select("u", (draw(F.col("at")) % F.greatest(F.col("at"), F.lit(1))).alias("pick"), (draw(F.col("at") + 13) % 2 == 0).alias("newer"))
        done = moved.where(F.col("newer") | (F.col("pick") == 0)).select("u", F.col("pick").alias("v"))
        found = done if found is None else found.unionByName(done)
        ties = moved.where(~F.col("newer") & (F.col("pick") > 0)).select("u", F.col("pick").alias("at"))
        if not ties.head(1):
            break
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def quiet_thresholds(state: DataFrame, top: DataFrame, x: str, memory: str, q: tuple[float, float, float] = (0.95, 0.95, 0.05)) -> DataFrame:
    """``uid, x_c, theta, theta_low, phi_c`` from the best quiet window of ``top`` (``uid, start, end, rank``), and the
    lowest pressure limit over all of them."""
    inside = state.join(top, "uid").where("t BETWEEN start AND end")
    each = inside.groupBy("uid", "rank").agg(*(F.percentile(c, F.lit(p)).alias(n) for c, p, n in ((x, q[0], "x_c"), (x, q[1], "high"), (memory, q[2], "phi_c"))))
    best = each.where("rank = 1").select("uid", "x_c", (F.col("high") / F.col("x_c")).alias("theta"), "phi_c")
    lowest = each.groupBy("uid").agg(F.min("high").alias("low"))
    return best.join(lowest, "uid").select("uid", "x_c", "theta", (F.col("low") / F.col("x_c")).alias("theta_low"), "phi_c")


def viscosity(state: DataFrame) -> DataFrame:
    """``uid, viscosity``: the longest rigid run times rigidity over what ways out are left while rigid; ``state`` has ``xi``."""
    some = F.count_if(F.col("xi") > 0)
    floor = F.greatest(F.when(some > 5, F.percentile(F.when(F.col("xi") > 0, F.col("xi")), F.lit(0.05))).otherwise(1e-12), F.lit(1e-12))
    rigid = F.col("regime") == "rigid"
    mean = lambda c: F.coalesce(F.avg(F.when(rigid, F.col(c))), F.lit(0.0))
    parts = state.groupBy("uid").agg(mean("eta").alias("eta"), mean("xi").alias("xi"), floor.alias("floor"))
    longest = series.runs(state, F.col("regime")).where(F.col("flag") == "rigid").groupBy("uid").agg(F.max("length").alias("tau"))
    return parts.join(longest, "uid", "left").select("uid", (F.coalesce("tau", F.lit(0)) * F.col("eta") / (F.col("xi") + F.col("floor"))).alias("viscosity"))


def cycle_ratio(state: DataFrame, cycles: str = "h1_count") -> DataFrame:
    """Adds ``xi``, cycles relative to the quiet share's high quantile (one at least), and its critical value ``xi_c``."""
    whole, calm = Window.partitionBy("uid"), series.quiet(STATE.quiet_share)
    at = lambda q: F.percentile(F.when(calm, F.col(cycles)), F.lit(q)).over(whole)
    ratio = F.col(cycles) / F.greatest(at(0.95), F.lit(1.0))
    placed = state.withColumn("xi", ratio)
    quiet_xi = F.when(calm, F.col("xi"))
    return placed.withColumn("xi_c", F.greatest(F.percentile(quiet_xi, F.lit(0.99)).over(whole), F.max(quiet_xi).over(whole)) * 1.02)
