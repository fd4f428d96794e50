"""Site-month counts kept up to date by Structured Streaming.

The counts of ``operators.counts`` are additive, so they can be held as the
state of a streaming aggregation: one row a study, group and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.calendar import month_int


def stream_site_months(events: DataFrame, numerator: Column, study_col: str = "studyid", group_col: str = "invid", date_col: str = "date", watermark: str | None = None) -> DataFrame:
    """StudyID, GroupID, MonthYYYYMM [, Day], Numerator, Denominator of a stream of dated events (or of a table).

    Numerator counts the events for which ``numerator`` holds.  Events without a
    date are left out.  With a ``watermark`` (such as "60 days") the rows are
    days, to be summed by month: days that end before it are final, their state
    is dropped, and so are later events for them; write such a stream in append
    or update mode, others in complete or update mode.
    """
    at = F.to_timestamp(date_col)
    rows = events.withColumn("_at", at).filter("_at is not null")
    keys = [F.col(study_col).alias("StudyID"), F.col(group_col).alias("GroupID"), month_int(F.to_date("_at")).alias("MonthYYYYMM")]
    sums = [F.count_if(numerator).alias("Numerator"), F.count(F.lit(1)).alias("Denominator")]
    if watermark is None:
        return rows.groupBy(*keys).agg(*sums)
    days = rows.withWatermark("_at", watermark).groupBy(*keys[:2], F.window("_at", "1 day").alias("_day")).agg(*sums)
    return days.select("StudyID", "GroupID", month_int(F.to_date("_day.start")).alias("MonthYYYYMM"), F.to_date("_day.start").alias("Day"), "Numerator", "Denominator")
