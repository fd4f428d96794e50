"""Tables in, tables out."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.validate import ValidationError

#: The column types of a spec and their Spark types.
TYPES = {"character": "string", "Date": "date", "integer": "int", "numeric": "double", "logical": "boolean"}


@dataclass(frozen=True)
class ColumnSpec:
    """A column of a domain: its name, type (None: as it is), and its name in the source if that differs."""

    name: str
    type: str | None = None
    source: str | None = None


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column if one is named."""
    if partition_column and bounds:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=options)
    return spark.read.jdbc(url, table, properties=options)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: list[str] | None = None, buckets: int = 200) -> None:
    """Save under a name; bucketed tables join without a shuffle on the bucket columns."""
    writer = df.write.mode(mode).format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a plan's result to a shared folder and go on from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_spec(df: DataFrame, spec: list[ColumnSpec], domain: str = "table", keep_all: bool = False, report_unparsable: bool = False) -> DataFrame:
    """Rename by source, cast by type; what can't be parsed becomes null.

    With ``keep_all`` columns without a spec stay.  ``report_unparsable`` counts
    the values lost to casts in one pass and warns of them.
    """
    missing = [s.name for s in spec if (s.source or s.name) not in df.columns and s.name not in df.columns]
    if missing:
        raise ValidationError(f"{domain} missing required columns: {', '.join(missing)}")
    source = lambda s: s.source if s.source and s.source in df.columns else s.name

    def cast(s: ColumnSpec):
        col = F.col(f"`{source(s)}`")
        kind = TYPES.get(s.type or "")
        return col.alias(s.name) if kind is None else col.try_cast(kind).alias(s.name)

    if report_unparsable:
        lost = [F.count_if(F.col(f"`{source(s)}`").isNotNull() & F.col(f"`{source(s)}`").try_cast(TYPES[s.type]).isNull()).alias(s.name) for s in spec if s.type in TYPES]
        if lost:
            for name, n in df.agg(*lost).first().asDict().items():
                if n:
                    warnings.warn(f"{domain}.{name}: {n} values could not be parsed and became null", stacklevel=2)
    taken = {source(s) for s in spec} | {s.name for s in spec}
    rest = [F.col(f"`{c}`") for c in df.columns if keep_all and c not in taken]
    return df.select(*map(cast, spec), *rest)


def ingest(raw: dict[str, DataFrame], specs: dict[str, list[ColumnSpec]], keep_all: bool = False) -> dict[str, DataFrame]:
    """Every domain with a spec, cast by it; the others as they are."""
    return {name: apply_spec(df, specs[name], name, keep_all) if name in specs else df for name, df in raw.items()}
