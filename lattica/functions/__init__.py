"""Numeric kernels and their registration as SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from lattica.functions import kernels
from lattica.runtime import ship


def register(spark: SparkSession) -> None:
    """SQL functions over arrays: ``eigenvalues(matrix)``, ``cycles(matrix)``, ``recurrence_rates(series)``."""
    ship(spark)

    def matrix(rows):
        return np.array([list(r) for r in rows], float)

    @pandas_udf("array<double>")
    def eigenvalues(m: pd.Series) -> pd.Series:
        return m.map(lambda rows: kernels.spectrum(matrix(rows)).tolist())

    @pandas_udf("struct<entropy:double,dominance:double,h1_count:long>")
    def cycles(m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.cycle_summary(matrix(rows)) for rows in m], columns=["entropy", "dominance", "h1_count"])

    @pandas_udf("struct<rr:double,det:double,lam:double,tt:double>")
    def recurrence_rates(s: pd.Series) -> pd.DataFrame:
        rows = [kernels.recurrence(kernels.embedded(x := np.array(v, float), kernels.delay(x))) for v in s]
        return pd.DataFrame(rows, columns=["rr", "det", "lam", "tt"])

    for name, function in (("eigenvalues", eigenvalues), ("cycles", cycles), ("recurrence_rates", recurrence_rates)):
        spark.udf.register(name, function)
