"""Panels ``(uid, t, asset, x)`` and series from the driver tables, and their cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.runtime import table


def trade_panel(spark: SparkSession, sf_dir: str, grain: str = "week", uid: str | None = None, asset: str = "r_name") -> DataFrame:
    """Order value by period and customer region (or nation); ``uid`` names the orders' or customers' column to split by."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    which = F.col(uid) if uid else F.lit("all")
    return joined.groupBy(which.alias("uid"), F.to_date(F.date_trunc(grain, "o_orderdate")).alias("t"), F.col(asset).alias("asset")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("x")
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by hour and type."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events.groupBy(F.lit("events").alias("uid"), hour.alias("t"), F.col("event_type").alias("asset")).agg(F.round(F.avg("value"), 6).alias("x"))


def revenue_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue: ``uid, t, x``."""
    items = table(spark, sf_dir, "lineitem")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy(F.lit("revenue").alias("uid"), F.to_date("l_shipdate").alias("t")).agg(F.round(F.sum(value), 4).alias("x"))


def by(*keys: str, order: str = "t") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def full_grid(panel: DataFrame) -> DataFrame:
    """Every asset of a universe on every date of it; cells without a value are null."""
    dates, assets = panel.select("uid", "t").distinct(), panel.select("uid", "asset").distinct()
    return dates.join(assets, "uid").join(panel, ["uid", "t", "asset"], "left")


def forward_filled(grid: DataFrame, limit: int | None = 5) -> DataFrame:
    """The last value of at most ``limit`` rows before takes a missing one's place (None: of any before)."""
    frame = by("uid", "asset").rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return grid.withColumn("x", F.last("x", ignorenulls=True).over(frame))


def complete_rows(grid: DataFrame) -> DataFrame:
    """Dates on which every asset of the universe has a value."""
    date = Window.partitionBy("uid", "t")
    counted = grid.withColumn("have", F.count("x").over(date)).withColumn("want", F.count(F.lit(1)).over(date))
    return counted.where("have = want").drop("have", "want")


def trimmed(panel: DataFrame, window: int, late_share: float = 0.4, limit: int = 5) -> DataFrame:
    """The permissive cleaning: fill short gaps, drop assets that start late, begin where all have begun, drop thin
    assets (under half of the rows, or under two windows), then dates that are not complete."""
    filled = forward_filled(full_grid(panel), limit)
    span = filled.groupBy("uid").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    started = filled.where("x IS NOT NULL").groupBy("uid", "asset").agg(F.min("t").alias("start"))
    cutoff = F.date_add("first", F.floor(F.datediff("last", "first") * late_share).cast("int"))
    early = started.join(span, "uid").where(F.col("start") <= cutoff).select("uid", "asset", "start")
    common = early.groupBy("uid").agg(F.max("start").alias("common"))
    kept = filled.join(early.drop("start"), ["uid", "asset"]).join(common, "uid").where("t >= common").drop("common")
    rows = kept.groupBy("uid").agg(F.countDistinct("t").alias("rows"))
    thick = kept.groupBy("uid", "asset").agg(F.count("x").alias("have")).join(rows, "uid")
    thick = thick.where(F.col("have") >= F.greatest(F.floor(F.col("rows") * 0.5), F.lit(2 * window))).select("uid", "asset")
    return complete_rows(kept.join(thick, ["uid", "asset"]))


def interpolated(grid: DataFrame, limit: int = 3) -> DataFrame:
    """Linear between the values around a gap, for at most the first ``limit`` cells of it."""
    before, after = by("uid", "asset").rowsBetween(Window.unboundedPreceding, 0), by("uid", "asset").rowsBetween(0, Window.unboundedFollowing)
    placed = grid.withColumn("i", F.row_number().over(by("uid", "asset")))
    known = F.when(F.col("x").isNotNull(), F.col("i"))
    ends = placed.withColumns({
        "i0": F.last(known, ignorenulls=True).over(before),
        "i1": F.first(known, ignorenulls=True).over(after),
        "x0": F.last("x", ignorenulls=True).over(before),
        "x1": F.first("x", ignorenulls=True).over(after),
    })
    line = F.col("x0") + (F.col("x1") - F.col("x0")) * F.try_divide(F.col("i") - F.col("i0"), F.col("i1") - F.col("i0"))
    inside = (F.col("i") - F.col("i0") <= limit) & F.col("x1").isNotNull()
    return ends.withColumn("x", F.when(F.col("x").isNotNull(), F.col("x")).when(inside, line)).select("uid", "t", "asset", "x")


def returns(panel: DataFrame, kind: str = "log") -> DataFrame:
    """Log or simple returns ``uid, t, asset, r``; the first row of an asset and infinite ones go."""
    ratio = F.try_divide("x", F.lag("x").over(by("uid", "asset")))
    value: Column = F.log(ratio) if kind == "log" else ratio - 1
    return panel.select("uid", "t", "asset", F.round(value, 10).alias("r")).where("r IS NOT NULL AND NOT isnan(r)")


def weekly_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as universes of regions, cleaned."""
    return complete_rows(forward_filled(full_grid(trade_panel(spark, sf_dir, uid="o_orderpriority"))))
