"""Joining KRIs that share a denominator, long format, binding results."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import validate
from tideline.operators.validate import ValidationError

IDS = ["GroupID", "GroupLevel", "Denominator", "StudyID", "MonthYYYYMM"]
WIDE = ("Numerator", "Metric", "Median", "Lower", "Upper")


def check_kinds(kinds: list, metrics: DataFrame) -> None:
    """Of (DenominatorType, MetricID, GroupLevel) rows: thresholds and levels agree within a denominator type."""
    limits: dict[str, set] = {}
    for r in metrics.select("MetricID", "AccrualThreshold").distinct().collect():
        limits.setdefault(r[0], set()).add(r[1])
    for kind in sorted({str(r[0]) for r in kinds}):
        own = [r for r in kinds if str(r[0]) == kind]
        known = sorted({(m, x) for _, m, _ in own for x in limits.get(m, ())}, key=str)
        if len({x for _, x in known}) > 1:
            listed = "\n".join(f"{m} {x}" for m, x in known)
            raise ValidationError(f"Cannot join KRIs with DenominatorType '{kind}' because they have different AccrualThreshold values:\n{listed}\n\nKRIs sharing the same DenominatorType must have identical AccrualThreshold (nMinDenominator) values because this parameter affects the Denominator calculation through date adjustment.")
        empty = sorted({str(m) for _, m, level in own if level is None or level == ""})
        if empty:
            raise ValidationError(f"KRIs with DenominatorType '{kind}' have missing or empty GroupLevel values: {', '.join(empty)}\n\nEnsure all KRI YAML files have 'GroupLevel' defined in the meta section (e.g., 'GroupLevel: Site').")
        if len({level for *_, level in own}) > 1:
            listed = "\n".join(sorted(f"{m} {level}" for _, m, level in own))
            raise ValidationError(f"Cannot join KRIs with DenominatorType '{kind}' because they have different GroupLevel values:\n{listed}\n\nKRIs sharing the same DenominatorType must have identical GroupLevel values for proper data alignment during pivot operations.")


def denominator_mismatch(input: DataFrame) -> DataFrame:
    """Site-months whose rows disagree on the denominator: DenominatorType, StudyID, GroupID, MonthYYYYMM, n."""
    return input.groupBy("DenominatorType", "StudyID", "GroupID", "MonthYYYYMM").agg(F.countDistinct("Denominator").alias("n")).filter("n > 1")


def mismatch_rows(input: DataFrame) -> DataFrame:
    """The rows behind ``denominator_mismatch``."""
    return input.join(denominator_mismatch(input), ["DenominatorType", "StudyID", "GroupID", "MonthYYYYMM"], "left_semi")


def join_kri_by_denominator(input: DataFrame, metrics: DataFrame, skip_validation: bool = False) -> dict[str, DataFrame]:
    """Per denominator type one wide table: IDS, Numerator_<MetricID>.. ; absent combinations are null.

    One job finds the kinds (a row for each denominator type, metric and level),
    one more whether site-months disagree or occur twice.
    """
    validate.table(input, "dfInput")
    if "DenominatorType" not in input.columns:
        raise ValidationError("dfInput must contain a 'DenominatorType' column. Use strDenominatorType parameter in Input_CountSiteByMonth.")
    kinds = [tuple(r) for r in input.select("DenominatorType", "MetricID", "GroupLevel").distinct().collect()]
    if not skip_validation:
        check_kinds(kinds, metrics)
        wrong = site_month_faults(input).orderBy("DenominatorType").limit(1).collect()  # one fault decides; its rows follow
        if wrong:
            kind, n, twice = wrong[0]
            if n:
                rows = mismatch_rows(input.filter(F.col("DenominatorType") == kind)).select("MetricID", "StudyID", "GroupID", "MonthYYYYMM", "Denominator").orderBy("StudyID", "GroupID", "MonthYYYYMM", "MetricID").limit(20)
                listed = "\n".join(" ".join(map(str, r)) for r in rows.collect())
                raise ValidationError(f"Cannot join KRIs with DenominatorType '{kind}' because they have different Denominator values for the same (StudyID, GroupID, MonthYYYYMM) combinations:\n{listed}\n\nThis indicates the KRIs are using different denominator calculation methods (e.g., one with strDenominatorEndDateCol, one without) or have mismatched data. Ensure all KRIs with the same DenominatorType use identical Input_CountSiteByMonth parameters.")
            raise ValidationError(f"dfInput has several rows for one site-month and metric of DenominatorType '{kind}'")
    found: dict[str, list[str]] = {}
    for kind, metric in sorted({(k, m) for k, m, _ in kinds}, key=lambda x: (str(x[0]), str(x[1]))):
        found.setdefault(kind, []).append(metric)
    return {kind: wide_numerators(input.filter(F.col("DenominatorType").eqNullSafe(kind)), ids) for kind, ids in found.items()}


def site_month_faults(input: DataFrame) -> DataFrame:
    """DenominatorType, n, twice: site-months with several denominators, and those with several rows of a metric."""
    months = input.groupBy("DenominatorType", "StudyID", "GroupID", "MonthYYYYMM", "MetricID", "GroupLevel").agg(F.min("Denominator").alias("_low"), F.max("Denominator").alias("_high"), F.count(F.lit(1)).alias("_rows"))
    whole = months.groupBy("DenominatorType", "StudyID", "GroupID", "MonthYYYYMM").agg((F.min("_low") < F.max("_high")).alias("_apart"), (F.max("_rows") > 1).alias("_twice"))
    return whole.groupBy("DenominatorType").agg(F.count_if("_apart").alias("n"), F.count_if("_twice").alias("twice")).filter("n > 0 or twice > 0")


def wide_numerators(input: DataFrame, metric_ids: list[str]) -> DataFrame:
    """Numerators side by side, one column a metric."""
    pick = [F.first(F.when(F.col("MetricID") == m, F.col("Numerator")), ignorenulls=True).alias(f"Numerator_{m}") for m in metric_ids]
    return input.groupBy(*IDS).agg(*pick)


def wide_ids(columns: list[str]) -> list[str]:
    found = [c.split("_", 1)[1] for c in columns if "_" in c and c.split("_", 1)[0] in WIDE]
    return list(dict.fromkeys(found))


def transform_long(wide: dict[str, DataFrame], denominator_col: str = "DenominatorType") -> DataFrame:
    """Wide tables by denominator type to one long table: MetricID, denominator, other columns, values without their ids."""
    if not isinstance(wide, dict) or not wide:
        raise ValidationError("lWide must be a non-empty named list")
    if not all(isinstance(k, str) and k for k in wide):
        raise ValidationError("lWide must have named elements (denominator types)")
    for kind, df in wide.items():
        if not isinstance(df, DataFrame):
            raise ValidationError(f"Element '{kind}' must be a data.frame or tbl")
    return reduce(DataFrame.unionByName, [one_long(df, kind, denominator_col) for kind, df in wide.items()])


def one_long(df: DataFrame, kind: str, denominator_col: str = "DenominatorType") -> DataFrame:
    """All metrics of one wide table in a single pass: an array with one struct a metric, exploded."""
    ids = wide_ids(df.columns)
    if not ids:
        return df.withColumn(denominator_col, F.lit(kind))
    names = [n for n in WIDE if any(f"{n}_{i}" in df.columns for i in ids)]
    rest = [c for c in df.columns if not ("_" in c and c.split("_", 1)[0] in WIDE)]
    kinds = {n: next(df.schema[f"{n}_{i}"].dataType for i in ids if f"{n}_{i}" in df.columns) for n in names}
    value = lambda n, i: F.col(f"`{n}_{i}`") if f"{n}_{i}" in df.columns else F.lit(None).cast(kinds[n])
    rows = F.array(*[F.struct(F.lit(i).alias("MetricID"), *[value(n, i).cast(kinds[n]).alias(n) for n in names]) for i in ids])
    long = df.select(*rest, F.explode(rows).alias("_m"))
    return long.select("_m.MetricID", F.lit(kind).alias(denominator_col), *[c for c in rest if c != denominator_col], *[F.col(f"_m.{n}").alias(n) for n in names])


def bind_results(analysis: dict[str, dict | DataFrame], name: str, snapshot_date: dt.date | str | None = None, study_id: str | None = None, use_data: bool = False) -> DataFrame:
    """The table ``name`` of each analysis (or, with ``use_data``, of its data) under its MetricID, with SnapshotDate [, StudyID]."""
    day = F.current_date() if snapshot_date is None else F.to_date(F.lit(str(snapshot_date)))
    parts = []
    for metric, found in analysis.items():
        held = found["lData"] if use_data and isinstance(found, dict) and "lData" in found else found
        df = held[name] if isinstance(held, dict) else held
        parts.append(df.withColumn("MetricID", F.lit(metric)))
    if not parts:
        raise ValidationError("lAnalysis must be a non-empty named list")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("SnapshotDate", day)
    return out if study_id is None else out.withColumn("StudyID", F.lit(study_id))


def bind_lists(*lists, **named) -> list[tuple]:
    """The items of all lists one after another as (name, value); the arguments' own names don't count, repeated names stay."""
    out: list[tuple] = []
    for part in [*lists, *named.values()]:
        out += list(part.items()) if isinstance(part, dict) else [x if isinstance(x, tuple) and len(x) == 2 else (None, x) for x in part]
    return out
