"""Site bootstrap by multiplicity weights, and percentile bounds.

A replicate's draws are counted per group, and the counts weigh the groups'
monthly sums; drawn rows are only repeated where a caller asks for them.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.draws import draw_index, uniform
from tideline.operators import validate
from tideline.operators.validate import ValidationError

log = logging.getLogger(__name__)

#: Replicates up to which a caller's table of them is broadcast.
REPLICATES = 100_000


def group_numbers(input: DataFrame, study_col: str = "StudyID", group_col: str = "GroupID") -> DataFrame:
    """study, group, GroupNumber (1 .. n in the order of names), ActualGroupCount."""
    groups = input.select(study_col, group_col).distinct()
    per_study = Window.partitionBy(study_col)
    return groups.select(study_col, group_col, F.dense_rank().over(per_study.orderBy(group_col)).cast("long").alias("GroupNumber"), F.count(F.lit(1)).over(per_study).alias("ActualGroupCount"))


def with_replicates(df: DataFrame, bootstrap_reps: int, replicates: DataFrame | None) -> DataFrame:
    """Each row once per replicate; a replicate table takes the place of 1 .. bootstrap_reps."""
    if replicates is not None:
        numbers = replicates.select(F.col("BootstrapRep").cast("int").alias("BootstrapRep")).distinct()
        return df.crossJoin(F.broadcast(numbers) if numbers.limit(REPLICATES + 1).count() <= REPLICATES else numbers)
    return df.withColumn("BootstrapRep", F.explode(F.sequence(F.lit(1), F.lit(int(bootstrap_reps)))))


def draw_weights(strata: DataFrame, keys: list[str], size: Column, draws: Column, bootstrap_reps: int, replicates: DataFrame | None, seed: int, method: str) -> DataFrame:
    """keys, BootstrapRep, GroupNumber, Weight: how often each of ``size`` group numbers comes up in ``draws`` draws."""
    reps = with_replicates(strata.select(*keys, size.alias("_size"), draws.alias("_draws")), bootstrap_reps, replicates).repartition(*keys, "BootstrapRep")
    drawn = reps.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("_draws").cast("int"))))
    number = draw_index(uniform(seed, *[F.col(k) for k in keys], F.col("BootstrapRep"), F.col("_at"), method=method), F.col("_size"))
    return drawn.select(*keys, "BootstrapRep", number.alias("GroupNumber")).groupBy(*keys, "BootstrapRep", "GroupNumber").agg(F.count(F.lit(1)).alias("Weight"))


def check_bootstrap(input: DataFrame, bootstrap_reps, groups, study_col: str, group_col: str) -> None:
    validate.table(input, "dfInput", "data frame or lazy table")
    for name, col in (("strStudyCol", study_col), ("strGroupCol", group_col)):
        if col not in input.columns:
            raise ValidationError(f"{name} '{col}' not found in dfInput")
    validate.positive_int(bootstrap_reps, "nBootstrapReps must be a single positive integer")
    validate.positive_int(groups, "nGroups must be NULL or a single positive integer", optional=True)


def bootstrap_weights(input: DataFrame, bootstrap_reps: int = 1000, groups: int | None = None, study_col: str = "StudyID", group_col: str = "GroupID", bootstrap_table: DataFrame | None = None, seed: int = 0, method: str = "xxhash64") -> DataFrame:
    """study, BootstrapRep, group, Weight: as many draws as the study has groups, or ``groups`` draws."""
    check_bootstrap(input, bootstrap_reps, groups, study_col, group_col)
    numbers = group_numbers(input, study_col, group_col)
    strata = numbers.groupBy(study_col).agg(F.max("ActualGroupCount").alias("_n"))
    weights = draw_weights(strata, [study_col], F.col("_n"), F.lit(groups) if groups else F.col("_n"), bootstrap_reps, bootstrap_table, seed, method)
    return weights.join(numbers.select(study_col, group_col, "GroupNumber"), [study_col, "GroupNumber"]).select(study_col, "BootstrapRep", group_col, "Weight")


def bootstrap_study(input: DataFrame, bootstrap_reps: int = 1000, groups: int | None = None, study_col: str = "StudyID", group_col: str = "GroupID", bootstrap_table: DataFrame | None = None, seed: int = 0, method: str = "xxhash64") -> DataFrame:
    """study, BootstrapRep and all columns of the input: every row of each drawn group, repeated as often as it was drawn."""
    weights = bootstrap_weights(input, bootstrap_reps, groups, study_col, group_col, bootstrap_table, seed, method)
    rest = [c for c in input.columns if c not in (study_col, group_col)]
    rows = weights.join(input, [study_col, group_col])
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("Weight").cast("int"))))
    return repeated.select(study_col, "BootstrapRep", group_col, *rest)


def group_months(input: DataFrame, keys: list[str], numerators: list[str]) -> DataFrame:
    """One row per group and month, so groups can be counted without distinct."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*numerators, "Denominator"]]
    return input.filter(F.col("MonthYYYYMM").isNotNull()).groupBy(*keys, F.col("MonthYYYYMM").cast("int").alias("MonthYYYYMM")).agg(*sums)


def weighted_months(rows: DataFrame, by: list[str], numerators: list[str]) -> DataFrame:
    """Monthly sums of weighted group-months, and the number of different groups drawn."""
    sums = [F.sum(F.col("Weight") * F.col(c)).alias(c) for c in [*numerators, "Denominator"]]
    return rows.groupBy(*by, "MonthYYYYMM").agg(*sums, F.count(F.lit(1)).alias("GroupCount"))


def study_bounds(input: DataFrame, by: str | list[str] | None = "StudyID", conf_level: float = 0.95, study_month_col: str = "StudyMonth") -> DataFrame:
    """by, StudyMonth, Median, Lower, Upper (with _id each for Metric_id columns), BootstrapCount: exact percentiles, linear between values."""
    validate.table(input, "dfInput")
    metrics = [c for c in input.columns if c.startswith("Metric")]
    if not metrics:
        raise ValidationError("dfInput must have at least one Metric column")
    validate.has_columns(input, "dfInput", [study_month_col, "BootstrapRep"])
    by = [] if by is None else [by] if isinstance(by, str) else list(by)
    missing = [c for c in by if c not in input.columns]
    if missing:
        raise ValidationError(f"vBy columns not found in dfInput: {', '.join(missing)}")
    validate.level(conf_level, "nConfLevel must be a single numeric value between 0 and 1")
    low = (1 - conf_level) / 2
    at = F.array(*[F.lit(p) for p in (0.5, low, 1 - low)])
    grouped = input.groupBy(*by, study_month_col).agg(*[F.percentile(m, at).alias(f"_{m}") for m in metrics], F.max("BootstrapRep").alias("BootstrapCount"))
    bounds = [F.col(f"_{m}")[k].alias(f"{name}{m.removeprefix('Metric')}") for m in metrics for k, name in enumerate(("Median", "Lower", "Upper"))]
    return grouped.select(*by, study_month_col, *bounds, "BootstrapCount")
