"""Site-month counts: numerator events against denominator events or exposure days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.calendar import month_int
from tideline.operators import validate
from tideline.operators.validate import ValidationError


def days_by_month(data: DataFrame, start_date_col: str, end_date_col: str, group_cols: list[str]) -> DataFrame:
    """Exposure days of [start, end], both included, by group and calendar month: group_cols, MonthYYYYMM, Days.

    Rows with a null date, and ranges that end in an earlier month than they
    start in, have no months; a range reversed within a month counts its
    non-positive days.
    """
    start, end = F.to_date(data[start_date_col]), F.to_date(data[end_date_col])
    rows = data.select(*[F.col(c) for c in group_cols], start.alias("_start"), end.alias("_end")).filter(F.trunc("_start", "MM") <= F.trunc("_end", "MM"))
    months = F.explode(F.sequence(F.trunc("_start", "MM"), F.trunc("_end", "MM"), F.expr("interval 1 month")))
    split = rows.withColumn("_month", months)
    days = F.datediff(F.least("_end", F.last_day("_month")), F.greatest("_start", "_month")) + 1
    return split.groupBy(*group_cols, month_int(F.col("_month")).alias("MonthYYYYMM")).agg(F.sum(days).cast("long").alias("Days"))


def start_thresholds(denominator: DataFrame, study_col: str, date_col: str, min_denominator: float) -> DataFrame:
    """Per study the latest date among its first ``min_denominator`` events by date: study_col, Threshold.

    Counts per date come first, so the window sees one row a study and day.
    Below one event no date qualifies and the threshold is null.
    """
    per_day = denominator.filter(F.col(date_col).isNotNull()).groupBy(study_col, F.to_date(date_col).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(study_col).orderBy("_day")) - F.col("_n")
    return per_day.withColumn("_before", before).groupBy(study_col).agg(F.max(F.when(F.col("_before") + 1 <= min_denominator, F.col("_day"))).alias("Threshold"))


def min_denominator_shift(numerator: DataFrame, denominator: DataFrame, study_col: str, numerator_date_col: str, denominator_date_col: str, denominator_end_date_col: str | None, min_denominator: float) -> tuple[DataFrame, DataFrame]:
    """Pull every event before the study's threshold up to it; a denominator's end moves by as many days as its start.

    Denominator rows without a start are dropped; where a study has a null
    threshold its denominators get a null start; a numerator of a study without
    denominators keeps its date.  MonthYYYYMM of the numerator follows its date.
    """
    limits = start_thresholds(denominator, study_col, denominator_date_col, min_denominator)
    start = F.to_date(denominator_date_col)
    den = denominator.filter(F.col(denominator_date_col).isNotNull()).join(limits, study_col, "left")
    moved = F.when(F.col("Threshold").isNotNull(), F.greatest(start, F.col("Threshold")))
    if denominator_end_date_col:
        den = den.withColumn(denominator_end_date_col, F.date_add(F.to_date(denominator_end_date_col), F.datediff(moved, start)))
    den = den.withColumn(denominator_date_col, moved).select(*denominator.columns)
    day = F.to_date(numerator_date_col)
    num = numerator.join(limits, study_col, "left").withColumn(numerator_date_col, F.when(day <= F.col("Threshold"), F.col("Threshold")).otherwise(day))
    if "MonthYYYYMM" in numerator.columns:
        num = num.withColumn("MonthYYYYMM", month_int(F.col(numerator_date_col)))
    return num.select(*numerator.columns), den


def count_site_by_month(
    subjects: DataFrame | None,
    numerator: DataFrame,
    denominator: DataFrame,
    study_col: str = "studyid",
    group_col: str = "invid",
    group_level: str = "Site",
    subject_col: str = "subjid",
    numerator_date_col: str | None = None,
    denominator_date_col: str | None = None,
    denominator_end_date_col: str | None = None,
    denominator_type: str | None = None,
    min_denominator: float = 0,
) -> DataFrame:
    """GroupID, GroupLevel, Numerator, Denominator, Metric, StudyID, MonthYYYYMM [, DenominatorType].

    Numerator counts dated events; Denominator counts dated events or, with an
    end date column, exposure days.  Both kinds of event go through one lookup
    join and one aggregation.  Metric is null where Denominator is 0.  A subject
    with two groups counts in both.  Without ``subjects`` both tables must bear
    the group column.
    """
    validate.table(numerator, "dfNumerator")
    validate.table(denominator, "dfDenominator")
    own = subjects is None
    validate.has_columns(numerator, "dfNumerator", [study_col, subject_col, numerator_date_col])
    validate.has_columns(denominator, "dfDenominator", [study_col, subject_col, denominator_date_col, denominator_end_date_col])
    if isinstance(min_denominator, bool) or not isinstance(min_denominator, (int, float)) or not min_denominator >= 0:
        raise ValidationError("nMinDenominator must be a single non-negative numeric value")
    if own:
        for df, name in ((numerator, "dfNumerator"), (denominator, "dfDenominator")):
            if group_col not in df.columns:
                raise ValidationError(f"GroupCol '{group_col}' not found in {name}")
        attach = lambda df: df
    else:
        validate.table(subjects, "dfSubjects")
        validate.has_columns(subjects, "dfSubjects", [study_col, group_col, subject_col])
        lookup = subjects.select(study_col, group_col, subject_col).distinct()
        attach = lambda df: df.join(lookup, [study_col, subject_col])

    def narrow(df: DataFrame, kind: int, date: str, end: str | None) -> DataFrame:
        group = [F.col(group_col)] if own else []
        return df.select(F.col(study_col), F.col(subject_col), *group, F.to_date(date).alias("_date"), (F.to_date(end) if end else F.lit(None).cast("date")).alias("_end"), F.lit(kind).alias("_kind")).filter("_date is not null" + (" and _end is not null" if end and not min_denominator else ""))

    events = attach(narrow(numerator, 1, numerator_date_col, None).unionByName(narrow(denominator, 0, denominator_date_col, denominator_end_date_col)))
    if min_denominator:
        num, den = events.filter("_kind = 1"), events.filter("_kind = 0")
        num, den = min_denominator_shift(num, den, study_col, "_date", "_date", "_end", min_denominator)
        events = num.unionByName(den).filter("_date is not null")
    keys = [F.col(study_col).alias("StudyID"), F.col(group_col).alias("GroupID")]
    if denominator_end_date_col:
        first, last = F.trunc("_date", "MM"), F.trunc("_end", "MM")
        span = F.when(F.col("_kind") == 1, F.array(first)).when(first <= last, F.sequence(first, F.greatest(first, last), F.expr("interval 1 month")))
        rows = events.select("*", F.explode(span).alias("_month"))
        days = F.datediff(F.least("_end", F.last_day("_month")), F.greatest("_date", "_month")) + 1
        weight = F.when(F.col("_kind") == 0, days)
    else:
        rows, weight = events.withColumn("_month", F.col("_date")), F.when(F.col("_kind") == 0, 1)
    counted = rows.groupBy(*keys, month_int(F.col("_month")).alias("MonthYYYYMM")).agg(F.sum("_kind").cast("long").alias("Numerator"), F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("Denominator"))
    out = [
        F.col("GroupID"),
        F.lit(group_level).alias("GroupLevel"),
        F.col("Numerator"),
        F.col("Denominator"),
        F.when(F.col("Denominator") != 0, F.col("Numerator") / F.col("Denominator")).alias("Metric"),
        F.col("StudyID"),
        F.col("MonthYYYYMM"),
    ]
    if denominator_type is not None:
        out.append(F.lit(denominator_type).alias("DenominatorType"))
    return counted.select(*out)
