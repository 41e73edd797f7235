"""Readers and writers beyond Parquet: graphs as text, states as JSON, manifests, append-only logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def parse_edges(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``source, target`` of lines of two integers; comments (# or %) and other lines go."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.col(line).rlike(r"^\s*[#%]")).select(*(keep or []), F.try_element_at(parts, F.lit(1)).try_cast("long").alias("source"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("target"))
    return rows.where("source IS NOT NULL AND target IS NOT NULL")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``graph, id, label`` and distinct edges ``graph, source, target`` of GML files, one graph each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("graph"), "value")
    node = r"node\s*\[[^\]]*\]"
    edge = r"edge\s*\[[^\]]*\]"
    number = lambda c, name: F.regexp_extract(c, rf"\b{name}\s+(-?\d+)", 1).try_cast("long")
    nodes = files.select("graph", F.explode(F.regexp_extract_all("value", F.lit(node), F.lit(0))).alias("n")).select("graph", number("n", "id").alias("id"), number("n", "value").alias("label"))
    edges = files.select("graph", F.explode(F.regexp_extract_all("value", F.lit(edge), F.lit(0))).alias("e")).select("graph", number("e", "source").alias("source"), number("e", "target").alias("target"))
    return nodes.where("id IS NOT NULL"), edges.where("source IS NOT NULL AND target IS NOT NULL").distinct()


def read_panel_csv(spark: SparkSession, path: str, assets: list[str], date: str = "date") -> DataFrame:
    """Wide CSV files as a long panel: one universe per file, named by it."""
    schema = ", ".join([f"`{date}` DATE", *(f"`{a}` DOUBLE" for a in assets)])
    wide = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    named = wide.withColumn("uid", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.csv)?$", 1))
    values = F.map_from_arrays(F.array(*[F.lit(a) for a in assets]), F.array(*[F.col(f"`{a}`") for a in assets]))
    return named.select("uid", F.col(date).alias("t"), F.explode(values).alias("asset", "x"))


def read_asset_files(spark: SparkSession, path: str, date: str = "Date", prefer: tuple[str, ...] = ("Close", "Adj Close")) -> DataFrame:
    """``t, asset, x`` of CSV files of one asset each, named by it: the first preferred column that a file's header has.

    Headers may differ from file to file; a file without a preferred column gives no rows, nor do rows without a date or
    a number. Dates that only some assets have are there for those: a full grid aligns them.
    """
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.csv)?$", 1).alias("asset"), F.split(F.rtrim(F.col("value")), ",", -1).alias("cells"))
    at = F.coalesce(*[F.nullif(F.array_position("cells", F.lit(c)), F.lit(0)) for c in prefer])
    headers = lines.where(F.col("cells")[0] == date).groupBy("asset").agg(F.max(at).cast("int").alias("at"))
    found = lines.where(F.col("cells")[0] != date).join(headers.where("at IS NOT NULL"), "asset")
    cell = F.try_element_at("cells", F.col("at")).try_cast("double")
    return found.select(F.col("cells")[0].try_cast("date").alias("t"), "asset", cell.alias("x")).where("t IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")


def finite(frame: DataFrame) -> DataFrame:
    """Numbers that are not finite become null."""
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return frame.select(*[F.when(odd(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in frame.schema])


def as_json(frame: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept, no number that JSON lacks."""
    clean = finite(frame)
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("value"))


def append_log(frame: DataFrame, path: str, run_date: str) -> None:
    """Appends a run's rows to a log partitioned by run date."""
    frame.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("append").partitionBy("run_date").parquet(path)


def write_run(path: str, state: DataFrame, viscosity: DataFrame, report: DataFrame) -> None:
    """What a run leaves: the state's rows by universe, the viscosity's numbers as ``uid, metric, value`` in CSV, and the
    report as a JSON text a universe, without numbers that JSON lacks."""
    state.write.mode("overwrite").partitionBy("uid").parquet(f"{path}/state")
    metrics = [c for c in viscosity.columns if c != "uid"]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    viscosity.select("uid", pairs.alias("p")).select("uid", "p.*").write.mode("overwrite").option("header", True).csv(f"{path}/viscosity")
    as_json(report).write.mode("overwrite").text(f"{path}/report")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The state of a run and its viscosity as ``uid, metrics`` (a map); a metric without a value is null."""
    pairs = spark.read.schema("uid string, metric string, value double").option("header", True).csv(f"{path}/viscosity")
    return spark.read.parquet(f"{path}/state"), pairs.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))  # a stated few metrics


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, digest`` of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose digest differs, or that one side lacks."""
    both = before.select("path", F.col("digest").alias("before")).join(now.select("path", F.col("digest").alias("now")), "path", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("now")))


def read_required_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV files of a stated schema; a required column that the header lacks is an error, not a column of nulls."""
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in required if c not in header]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast(t).alias(c) if c in header else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def coerced(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers; what is none, or not finite, becomes zero."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    good = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))
    return frame.withColumns({c: F.when(good(c), number(c)).otherwise(0.0) for c in columns})


def append_new(panel: DataFrame, path: str) -> DataFrame:
    """Appends those rows of a panel ``uid, t, asset, x`` whose date lies behind the last kept one of their asset.

    Returns what is kept now. The last dates, a row an asset, decide; kept rows are never rewritten.
    """
    spark = panel.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        last = spark.read.schema(panel.schema).parquet(path).groupBy("uid", "asset").agg(F.max("t").alias("_last"))
        panel = panel.join(last, ["uid", "asset"], "left").where("_last IS NULL OR t > _last").select(*panel.columns)
    panel.write.mode("append").parquet(path)
    return spark.read.schema(panel.schema).parquet(path)


def write_bundle(frame: DataFrame, path: str) -> None:
    """Rows by universe, one folder each, which a reader of few universes prunes."""
    frame.write.mode("overwrite").partitionBy("uid").parquet(path)


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bundle's rows in a stated schema: numbers that it has no column for are zero, other columns null."""
    have, wanted = spark.read.parquet(path), spark.createDataFrame([], schema).schema
    numeric = ("byte", "short", "integer", "long", "float", "double")
    filled = lambda f: F.lit(0).cast(f.dataType) if f.dataType.typeName() in numeric else F.lit(None).cast(f.dataType)
    return have.select(*[(F.col(f.name).cast(f.dataType) if f.name in have.columns else filled(f)).alias(f.name) for f in wanted])


def archive_snapshot(frame: DataFrame, path: str, run_date: str) -> None:
    """Puts a day's rows in the place of that day's, and leaves all other days as they are."""
    dated = frame.withColumn("run_date", F.lit(run_date).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def new_alerts(before: DataFrame, now: DataFrame, run_date: str) -> DataFrame:
    """Rows for an alert log: ``run_date, uid, before, after`` where a level ``uid, alert`` changed or is new."""
    both = now.select("uid", F.col("alert").alias("after")).join(before.select("uid", F.col("alert").alias("before")), "uid", "left")
    return both.where(~F.col("after").eqNullSafe(F.col("before"))).select(F.lit(run_date).cast("date").alias("run_date"), "uid", "before", "after")


def save_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """A model's arrays as Parquet: one row each, with type and shape."""
    rows = [(name, str(a.dtype), list(a.shape), np.ascontiguousarray(a).tobytes()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
