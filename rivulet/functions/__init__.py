"""Scalar functions: Columns where Spark can express them, Arrow UDFs where it can't. register() names them for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """SQL names for the functions that need Python; the others are expressions."""
    from . import html, simhash

    @F.pandas_udf("string")
    def html_text(x: pd.Series) -> pd.Series:
        return x.map(html.normalize)

    @F.pandas_udf("bigint")
    def body_simhash(x: pd.Series) -> pd.Series:
        return x.map(simhash.fingerprint).astype("Int64")

    spark.udf.register("html_text", html_text)
    spark.udf.register("body_simhash", body_simhash)
