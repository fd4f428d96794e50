"""Months as YYYYMM integers and as first-of-month dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_int(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def month_date(month: Column) -> Column:
    month = month.cast("int")
    return F.make_date(F.floor(month / 100).cast("int"), (month % 100).cast("int"), F.lit(1))


def this_month(as_of: dt.date | str | None) -> Column:
    """First day of the month of ``as_of``, by default of today."""
    return F.trunc(F.current_date() if as_of is None else F.to_date(F.lit(str(as_of))), "MM")


def month_sequence(spark: SparkSession, start: int, end: int) -> DataFrame:
    """MonthYYYYMM from ``start`` to ``end``, both included; empty if reversed."""
    first, last = month_date(F.lit(start)), month_date(F.lit(end))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(months).alias("m")).select(month_int(F.col("m")).alias("MonthYYYYMM"))
