"""Study timelines: calendar aggregation, gap filling, cumulative rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import month_date, month_int, this_month
from tideline.operators import validate
from tideline.operators.validate import ValidationError


def numerator_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("Numerator")]


def metric_name(numerator: str) -> str:
    return "Metric" + numerator.removeprefix("Numerator")


def fill_months(monthly: DataFrame, by: list[str], values: list[str], as_of: dt.date | str | None = None, month_sequence: DataFrame | None = None) -> DataFrame:
    """One row for each month from a series' first to its last, with 0 in gap months, and StudyMonth 1 .. n.

    ``monthly`` has one row per (by, MonthYYYYMM).  A series ends with the month
    of ``as_of`` at the latest.  Each row brings the gap after it along, so the
    series is sorted once and joined with nothing.  A month table cuts the
    series down to its months.
    """
    series = Window.partitionBy(*by).orderBy("_month")
    now = this_month(as_of)
    rows = monthly.withColumn("_month", month_date(F.col("MonthYYYYMM")))
    after = F.lead("_month").over(series)
    rows = rows.withColumn("_first", F.first("_month").over(series)).withColumn("_until", F.when(after.isNull(), F.col("_month")).otherwise(F.least(F.add_months(after, -1), now)))
    rows = rows.filter(F.col("_month") <= now)
    filled = rows.select(*[c for c in rows.columns if c != "_month"], F.posexplode(F.sequence("_month", F.greatest("_month", "_until"), F.expr("interval 1 month"))).alias("_nth", "_at"))
    zero = [F.when(F.col("_nth") == 0, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values]
    number = (F.round(F.months_between("_at", "_first")) + 1).cast("long")
    out = filled.select(*by, month_int(F.col("_at")).alias("MonthYYYYMM"), number.alias("StudyMonth"), *zero)
    if month_sequence is None:
        return out
    months = month_sequence.select(F.col("MonthYYYYMM").cast("int").alias("MonthYYYYMM")).distinct()
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy("MonthYYYYMM")).cast("long")
    return out.join(months, "MonthYYYYMM", "left_semi").withColumn("StudyMonth", rank).select(*by, "MonthYYYYMM", "StudyMonth", *values)


def aggregate_study_month(input: DataFrame, by: list[str], numerator_cols: list[str], month_sequence: DataFrame | None = None, as_of: dt.date | str | None = None, group_col: str = "GroupID") -> DataFrame:
    """Monthly sums and the number of groups active in each month, gaps filled: by, MonthYYYYMM, StudyMonth, sums, GroupCount."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*numerator_cols, "Denominator"]]
    monthly = input.filter(F.col("MonthYYYYMM").isNotNull()).groupBy(*by, F.col("MonthYYYYMM").cast("int").alias("MonthYYYYMM")).agg(*sums, F.countDistinct(group_col).alias("GroupCount"))
    return fill_months(monthly, by, [*numerator_cols, "Denominator", "GroupCount"], as_of, month_sequence)


def cumulative_counts(aggregated: DataFrame, by: list[str], numerator_cols: list[str]) -> DataFrame:
    """Running sums by StudyMonth and their rates; a rate is null while the running denominator isn't positive."""
    run = Window.partitionBy(*by).orderBy("StudyMonth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {c: F.sum(c).over(run) for c in [*numerator_cols, "Denominator"]}
    rows = aggregated.withColumns(sums)
    return rows.withColumns({metric_name(c): F.when(F.col("Denominator") > 0, F.col(c) / F.col("Denominator")) for c in numerator_cols})


def order_columns(df: DataFrame, by: list[str], numerator_cols: list[str]) -> DataFrame:
    return df.select(*by, "MonthYYYYMM", "StudyMonth", *numerator_cols, "Denominator", *map(metric_name, numerator_cols), "GroupCount")


def cumulative_timeline(input: DataFrame, by: str | list[str], month_sequence: DataFrame | None = None, as_of: dt.date | str | None = None, group_col: str = "GroupID") -> DataFrame:
    """by, MonthYYYYMM, StudyMonth, Numerator[_id].., Denominator, Metric[_id].., GroupCount of each series' timeline."""
    validate.table(input, "dfInput", "data frame or tbl object")
    validate.has_columns(input, "dfInput", [group_col, "Denominator", "MonthYYYYMM"])
    numerators = numerator_columns(input)
    if not numerators:
        raise ValidationError("dfInput must have at least one Numerator column")
    by = validate.strings(by, "vBy must be a non-empty character vector")
    missing = [c for c in by if c not in input.columns]
    if missing:
        raise ValidationError(f"vBy columns not found in dfInput: {', '.join(missing)}")
    monthly = aggregate_study_month(input, by, numerators, month_sequence, as_of, group_col)
    return order_columns(cumulative_counts(monthly, by, numerators), by, numerators)
