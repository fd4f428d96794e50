import datetime as dt

import pytest

from tideline.operators import counts
from tideline.operators.validate import ValidationError

D = dt.date
SUBJECTS = "studyid string, invid string, subjid string"
EVENTS = "studyid string, subjid string, day date"
SPANS = "studyid string, subjid string, start_date date, end_date date"


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([("S1", "A", "1"), ("S1", "A", "1"), ("S1", "B", "2")], SUBJECTS)


def count(subjects, num, den, **kw):
    kw = {"numerator_date_col": "day", "denominator_date_col": "day"} | kw
    return {(r["GroupID"], r["MonthYYYYMM"]): (r["Numerator"], r["Denominator"], r["Metric"]) for r in counts.count_site_by_month(subjects, num, den, **kw).collect()}


def test_counts_and_zero_denominator(spark, subjects):
    num = spark.createDataFrame([("S1", "1", D(2024, 1, 5)), ("S1", "1", D(2024, 1, 6)), ("S1", "2", None), ("S1", "9", D(2024, 1, 1))], EVENTS)
    den = spark.createDataFrame([("S1", "1", D(2024, 1, 1))] * 4, EVENTS)
    assert count(subjects, num, den) == {("A", 202401): (2, 4, 0.5)}
    none = spark.createDataFrame([], EVENTS)
    assert count(subjects, num, none) == {("A", 202401): (2, 0, None)}
    assert count(subjects, none, none) == {}


def test_columns(spark, subjects):
    ev = spark.createDataFrame([("S1", "1", D(2024, 1, 5))], EVENTS)
    out = counts.count_site_by_month(subjects, ev, ev, numerator_date_col="day", denominator_date_col="day", denominator_type="Visits")
    assert out.columns == ["GroupID", "GroupLevel", "Numerator", "Denominator", "Metric", "StudyID", "MonthYYYYMM", "DenominatorType"]


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [
        (D(2024, 1, 10), D(2024, 1, 20), {202401: 11}),
        (D(2024, 2, 1), D(2024, 2, 29), {202402: 29}),
        (D(2023, 2, 1), D(2023, 2, 28), {202302: 28}),
        (D(2024, 4, 1), D(2024, 5, 31), {202404: 30, 202405: 31}),
        (D(2024, 1, 15), D(2024, 3, 15), {202401: 17, 202402: 29, 202403: 15}),
        (D(2024, 3, 15), D(2024, 1, 15), {}),
        (D(2024, 3, 15), D(2024, 3, 10), {202403: -4}),
        (D(2024, 3, 15), None, {}),
    ],
)
def test_days(spark, subjects, start, end, days):
    spans = spark.createDataFrame([("S1", "1", start, end)], SPANS)
    got = {r["MonthYYYYMM"]: r["Days"] for r in counts.days_by_month(spans, "start_date", "end_date", ["studyid"]).collect()}
    assert got == days
    none = spark.createDataFrame([], EVENTS)
    whole = count(subjects, none, spans, denominator_date_col="start_date", denominator_end_date_col="end_date")
    assert {m: d for (_, m), (_, d, _) in whole.items()} == days


def test_shift(spark):
    starts = [D(2024, 1, d) for d in (1, 3, 5, 10, 15)]
    ends = [D(2024, 2, d) for d in (1, 5, 10, 15, 20)]
    den = spark.createDataFrame([("S1", "1", s, e) for s, e in zip(starts, ends)] + [("S1", "1", None, None)], SPANS)
    num = spark.createDataFrame([("S1", "1", D(2024, 1, 2), 202401), ("S1", "1", D(2024, 3, 1), 202403), ("S9", "1", D(2024, 1, 1), 202401)], "studyid string, subjid string, day date, MonthYYYYMM int")
    n, d = counts.min_denominator_shift(num, den, "studyid", "day", "start_date", "end_date", 3)
    assert sorted((r["start_date"].day, r["end_date"].isoformat()) for r in d.collect()) == [(5, "2024-02-05"), (5, "2024-02-07"), (5, "2024-02-10"), (10, "2024-02-15"), (15, "2024-02-20")]
    assert sorted(r["day"] for r in n.collect()) == [D(2024, 1, 1), D(2024, 1, 5), D(2024, 3, 1)]
    _, gone = counts.min_denominator_shift(num, den, "studyid", "day", "start_date", "end_date", 0.5)
    assert all(r["start_date"] is None for r in gone.collect())


def test_thresholds_by_study(spark):
    den = spark.createDataFrame([("S1", "1", D(2024, 1, d)) for d in (1, 3, 9)] + [("S2", "1", D(2024, 2, d)) for d in (1, 3)] + [("S3", "1", D(2024, 5, 1))], EVENTS)
    got = {r["studyid"]: r["Threshold"] for r in counts.start_thresholds(den, "studyid", "day", 2).collect()}
    assert got == {"S1": D(2024, 1, 3), "S2": D(2024, 2, 3), "S3": D(2024, 5, 1)}


def test_messages(spark, subjects):
    ev = spark.createDataFrame([("S1", "1", D(2024, 1, 5))], EVENTS)
    with pytest.raises(ValidationError, match="dfNumerator must be a data.frame or tbl object"):
        counts.count_site_by_month(subjects, 1, ev)
    with pytest.raises(ValidationError, match="dfDenominator missing required columns: nope"):
        counts.count_site_by_month(subjects, ev, ev, numerator_date_col="day", denominator_date_col="nope")
    with pytest.raises(ValidationError, match="nMinDenominator must be a single non-negative"):
        count(subjects, ev, ev, min_denominator=-1)
    with pytest.raises(ValidationError, match="GroupCol 'invid' not found in dfNumerator"):
        count(None, ev, ev)
