"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from types import TracebackType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the text bytes that one Python step holds at a time.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only where none is set and the driver is the executor."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    # shuffle files go once the table is written, not when the driver happens to collect its garbage
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return _written(df, name)[0]


class Shelf:
    """Tables that an operator writes to the shared folder on its way; all are removed at the end.

    A table put under a name that is taken removes the earlier one once it is
    written, so it may be made from it; nothing read lazily from the earlier one
    may be used after that.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.drop(*self.paths)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _written(df, name)
        self.drop(name)
        self.paths[name] = path
        return table

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about equal bytes, at most ``limit`` each.

    A single longer row makes a run of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def safe_parts(text: bytes, size: int) -> Iterator[bytes]:
    """Cut at ASCII white space into parts of about ``size`` bytes; a longer word stays whole."""
    start = 0
    while len(text) - start > size and (found := _WHITE.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
