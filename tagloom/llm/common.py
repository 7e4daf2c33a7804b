"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize

# The white space of all word and normalisation rules: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: computed once, read again after an executor is lost."""
    return materialize(df, name)


# A setting of Spark 4.1: exchanges of an execution leave the executors' disks when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``written``, without leaving its exchanges on disk until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: clashing extra columns cannot interfere."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fold(doc_id: Column) -> Column:
    """0, 1 or 2 by the CRC of the id as text; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3


def arrow_rows(
    df: DataFrame, function: Callable[[list], Iterable[list]], schema: str, *inputs: str, rows: int = 500
) -> DataFrame:
    """Map slices of rows in Arrow batches.

    ``function`` gets one list per input column and returns one list per
    output column.  At most ``rows`` rows are Python objects at once.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                columns = function(*[c.to_pylist() for c in part.columns])
                arrays = [pa.array(v, f.type) for v, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        # The worker lives on for other tasks: what Arrow holds in reserve goes back.
        pa.default_memory_pool().release_unused()

    return df.select(*inputs).mapInArrow(run, schema)
