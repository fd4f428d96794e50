"""Bounds of a study's own timeline and of its reference studies'."""

from __future__ import annotations

import datetime as dt
import logging
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import validate
from tideline.operators.bootstrap import bootstrap_weights, check_bootstrap, draw_weights, group_months, group_numbers, study_bounds, weighted_months
from tideline.operators.timeline import cumulative_counts, fill_months, metric_name, numerator_columns
from tideline.operators.validate import ValidationError

log = logging.getLogger(__name__)


def _numerators(input: DataFrame) -> list[str]:
    found = numerator_columns(input)
    if not found:
        raise ValidationError("dfInput must have at least one Numerator column")
    return found


def bootstrap_timeline(input: DataFrame, bootstrap_reps: int, month_sequence: DataFrame | None, study_col: str, group_col: str, bootstrap_table: DataFrame | None, seed: int, method: str, as_of, groups: int | None = None) -> DataFrame:
    """Cumulative timeline of every (BootstrapRep, study)."""
    numerators = _numerators(input)
    weights = bootstrap_weights(input, bootstrap_reps, groups, study_col, group_col, bootstrap_table, seed, method)
    months = group_months(input, [study_col, group_col], numerators)
    by = ["BootstrapRep", study_col]
    monthly = weighted_months(months.join(weights, [study_col, group_col]), by, numerators)
    filled = fill_months(monthly, by, [*numerators, "Denominator", "GroupCount"], as_of, month_sequence)
    return cumulative_counts(filled, by, numerators)


def predict_bounds(input: DataFrame, study_ref: DataFrame | None = None, bootstrap_reps: int = 1000, conf_level: float = 0.95, bootstrap_table: DataFrame | None = None, month_sequence: DataFrame | None = None, study_col: str = "StudyID", group_col: str = "GroupID", study_month_col: str = "StudyMonth", seed: int = 0, method: str = "xxhash64", as_of: dt.date | str | None = None) -> DataFrame:
    """Bounds of each study (of the targets in ``study_ref``'s first column, if given) from its own sites."""
    check_bootstrap(input, bootstrap_reps, None, study_col, group_col)
    validate.level(conf_level, "nConfLevel must be a single numeric value between 0 and 1")
    if study_ref is not None:
        if not isinstance(study_ref, DataFrame):
            raise ValidationError("dfStudyRef must be a data.frame, tbl object, or NULL")
        if not study_ref.columns:
            raise ValidationError("dfStudyRef must have at least one column")
        targets = study_ref.select(F.col(study_ref.columns[0]).alias(study_col)).filter(F.col(study_col).isNotNull()).distinct()
        if targets.isEmpty():
            raise ValidationError("No target studies found in dfStudyRef")
        input = input.join(targets, study_col, "left_semi")
    else:
        if log.isEnabledFor(logging.INFO):
            log.info("Using all %d studies found in dfInput", input.select(study_col).distinct().count())
    timeline = bootstrap_timeline(input, bootstrap_reps, month_sequence, study_col, group_col, bootstrap_table, seed, method, as_of)
    if study_month_col != "StudyMonth":
        timeline = timeline.withColumnRenamed("StudyMonth", study_month_col)
    return study_bounds(timeline, study_col, conf_level, study_month_col)


def reference_timelines(input: DataFrame, pairs: DataFrame, bootstrap_reps: int, mix_studies: bool, bootstrap_table: DataFrame | None, month_sequence: DataFrame | None, study_col: str, group_col: str, seed: int, method: str, as_of) -> DataFrame:
    """Replicated timelines of all targets in one plan: _target, BootstrapRep, StudyMonth, Metric...

    ``pairs`` has _target, _ref, _groups (draws from each of a target's
    references).  Default: each reference study has a timeline, extended by its
    last cumulative row up to the longest of its target and replicate.  Mixed:
    the references' monthly sums are added by study month before cumulating.
    """
    numerators = _numerators(input)
    input = input.select(F.col(study_col).alias("_ref"), F.col(group_col).alias("_group"), "MonthYYYYMM", *numerators, "Denominator")
    numbers = group_numbers(input, "_ref", "_group")
    sizes = numbers.groupBy("_ref").agg(F.max("ActualGroupCount").alias("_n"))
    strata = pairs.join(sizes, "_ref")
    keys = ["_target", "_ref"]
    weights = draw_weights(strata, keys, F.col("_n"), F.col("_groups"), bootstrap_reps, bootstrap_table, seed, method)
    months = group_months(input, ["_ref", "_group"], numerators).join(numbers.select("_ref", "_group", "GroupNumber"), ["_ref", "_group"])
    by = [*keys, "BootstrapRep"]
    monthly = weighted_months(months.join(weights, ["_ref", "GroupNumber"]), by, numerators)
    filled = fill_months(monthly, by, [*numerators, "Denominator", "GroupCount"], as_of, month_sequence)
    if mix_studies:
        mixed = filled.groupBy("_target", "BootstrapRep", "StudyMonth").agg(*[F.sum(c).alias(c) for c in [*numerators, "Denominator"]])
        return cumulative_counts(mixed, ["_target", "BootstrapRep"], numerators)
    lines = cumulative_counts(filled, by, numerators).select(*by, "StudyMonth", *map(metric_name, numerators))
    return carry_forward(lines, by, ["_target", "BootstrapRep"])


def carry_forward(lines: DataFrame, series: list[str], scope: list[str]) -> DataFrame:
    """Each series' last row repeated for the study months up to the longest series of its scope."""
    longest = F.max("StudyMonth").over(Window.partitionBy(*scope))
    own = F.max("StudyMonth").over(Window.partitionBy(*series))
    rows = lines.withColumns({"_own": own, "_longest": longest})
    until = F.when(F.col("StudyMonth") == F.col("_own"), F.col("_longest")).otherwise(F.col("StudyMonth"))
    rest = [c for c in lines.columns if c != "StudyMonth"]
    return rows.select(*rest, F.explode(F.sequence("StudyMonth", until)).alias("StudyMonth"))


def predict_bounds_ref_set(input: DataFrame, study_filter: list[str] | None = None, bootstrap_reps: int = 1000, conf_level: float = 0.95, study_col: str = "StudyID", group_col: str = "GroupID", study_month_col: str = "StudyMonth", mix_studies: bool = False, bootstrap_table: DataFrame | None = None, month_sequence: DataFrame | None = None, min_groups: int | None = None, seed: int = 0, method: str = "xxhash64", as_of: dt.date | str | None = None) -> DataFrame:
    """Bounds of several studies pooled, each drawn with the smallest group count among them (or ``min_groups``): StudyMonth, bounds, BootstrapCount, GroupCount, StudyCount."""
    validate.table(input, "dfInput")
    _numerators(input)
    validate.has_columns(input, "dfInput", [study_col, group_col, "Denominator", "MonthYYYYMM"])
    if study_filter is not None:
        study_filter = validate.strings(study_filter, "vStudyFilter must be a non-empty character vector")
    validate.positive_int(bootstrap_reps, "nBootstrapReps must be a positive integer")
    validate.level(conf_level, "nConfLevel must be between 0 and 1")
    validate.positive_int(min_groups, "nMinGroups must be a single positive integer", optional=True)
    chosen = input if study_filter is None else input.filter(F.col(study_col).isin(study_filter))
    sizes = chosen.groupBy(study_col).agg(F.countDistinct(group_col).alias("_n"))
    if log.isEnabledFor(logging.INFO):
        found = sizes.agg(F.count(F.lit(1)), F.min("_n")).first()
        if study_filter is None:
            log.info("No vStudyFilter specified. Using all %d studies.", found[0])
        log.info("Calculated minimum group count: %d" if min_groups is None else "Using provided minimum group count: %d", found[1] or 0 if min_groups is None else min_groups)
    pairs = sizes.select(F.lit("").alias("_target"), F.col(study_col).alias("_ref"), "_n")
    every = Window.partitionBy("_target")
    least = F.lit(int(min_groups)).cast("long") if min_groups is not None else F.min("_n").over(every)
    count = F.lit(len(study_filter)).cast("long") if study_filter is not None else F.count(F.lit(1)).over(every)
    pairs = pairs.select("_target", "_ref", least.alias("_groups"), count.alias("_count"))
    lines = reference_timelines(chosen, pairs.drop("_count"), bootstrap_reps, mix_studies, bootstrap_table, month_sequence, study_col, group_col, seed, method, as_of)
    bounds = study_bounds(lines, "_target", conf_level)
    facts = pairs.groupBy("_target").agg(F.max("_groups").alias("GroupCount"), F.max("_count").alias("StudyCount"))
    out = bounds.join(facts, "_target").drop("_target")
    return out.withColumnRenamed("StudyMonth", study_month_col) if study_month_col != "StudyMonth" else out


def input_context(input: DataFrame) -> str:
    """What a warning says about an input: its KRIs and its denominator types, of which there are as many as kinds of exposure."""
    out = ""
    kris = [c.removeprefix("Numerator_") for c in input.columns if c.startswith("Numerator_")]
    if kris:
        out += f" KRI: {', '.join(kris)}."
    if "DenominatorType" in input.columns:
        types = sorted(str(r[0]) for r in input.select("DenominatorType").distinct().collect() if r[0] is not None)
        out += f" DenominatorType: {', '.join(types)}."
    return out


def predict_bounds_ref(input: DataFrame, study_ref: DataFrame, bootstrap_reps: int = 1000, conf_level: float = 0.95, study_col: str = "StudyID", group_col: str = "GroupID", study_month_col: str = "StudyMonth", min_groups_col: str = "MinGroups", mix_studies: bool = False, bootstrap_table: DataFrame | None = None, month_sequence: DataFrame | None = None, compute: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0, method: str = "xxhash64", as_of: dt.date | str | None = None, warn: bool = True) -> DataFrame:
    """Reference bounds of every target: StudyMonth, bounds, BootstrapCount, GroupCount, StudyCount, StudyID, StudyRefID.

    ``study_ref`` gives target and reference by position.  References without
    data are left out; a target without any is skipped, with a warning.  All
    targets are one plan, with draws of their own each.  StudyRefID lists the
    references that have data in the order of ``study_ref``'s rows.  MinGroups
    must not differ between the references of a target.
    """
    validate.table(input, "dfInput")
    validate.table(study_ref, "dfStudyRef")
    if len(study_ref.columns) < 2:
        raise ValidationError("dfStudyRef must have at least 2 columns (target study in column 1, reference study in column 2)")
    if compute is not None and not callable(compute):
        raise ValidationError("funCompute is not a function")
    _numerators(input)
    validate.positive_int(bootstrap_reps, "nBootstrapReps must be a positive integer")
    validate.level(conf_level, "nConfLevel must be between 0 and 1")
    target, ref = study_ref.columns[:2]
    given = F.col(min_groups_col).cast("long") if min_groups_col in study_ref.columns else F.lit(None).cast("long")
    rows = study_ref.select(F.col(target).alias("_target"), F.col(ref).alias("_ref"), given.alias("_given"), F.monotonically_increasing_id().alias("_place"))
    asked = rows.groupBy("_target", "_ref", "_given").agg(F.min("_place").alias("_place"))
    sizes = input.groupBy(F.col(study_col).alias("_ref")).agg(F.countDistinct(group_col).alias("_n"))
    found = asked.join(sizes, "_ref")
    if warn:
        lost = asked.select("_target").distinct().join(found.select("_target").distinct(), "_target", "left_anti").orderBy("_target").collect()
        context = input_context(input) if lost else ""
        for row in lost:
            warnings.warn(f"Skipping study '{row[0]}': none of its reference studies found in data.{context}", stacklevel=2)
        if lost and found.isEmpty():
            warnings.warn(f"No results produced: no reference studies found in data for any target study.{context}", stacklevel=2)
        uneven = asked.filter("_given is not null").groupBy("_target").agg(F.countDistinct("_given").alias("n")).filter("n > 1")
        if min_groups_col in study_ref.columns and not uneven.isEmpty():
            raise ValidationError("nMinGroups must be a single positive integer")
    every = Window.partitionBy("_target")
    pairs = found.select("_target", "_ref", "_place", F.coalesce("_given", F.min("_n").over(every)).alias("_groups"))
    lines = reference_timelines(input, pairs.drop("_place"), bootstrap_reps, mix_studies, bootstrap_table, month_sequence, study_col, group_col, seed, method, as_of)
    bounds = study_bounds(lines, "_target", conf_level)
    facts = pairs.groupBy("_target").agg(F.max("_groups").alias("GroupCount"), F.count(F.lit(1)).alias("StudyCount"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_ref"))), lambda x: x["_ref"]), ", ").alias("StudyRefID"))
    out = bounds.join(facts, "_target")
    values = [c for c in bounds.columns if c != "_target"]
    out = out.select(*[F.col(c).alias(study_month_col if c == "StudyMonth" else c) for c in values], "GroupCount", "StudyCount", F.col("_target").alias("StudyID"), "StudyRefID")
    return compute(out) if compute else out
