"""Running a Python function over texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per batch handed on; bounds what one task holds.
BATCH_ROWS = 4000


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], ddl: str) -> DataFrame:
    """Each row's values, in column order, give any number of rows of ``ddl``.

    ``make`` runs once per task and returns the function, so that models and tokenizers are
    set up once. Nothing is held beyond one batch in and one batch out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        rows: list[tuple] = []
        for b in batches:
            for values in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows.extend(f(*values))
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Below this many bytes (by the optimizer's estimate) rows are dealt out evenly before costly
#: Python work, since few files make few tasks; above it the scan's own splits are enough.
SPREAD_BELOW = 8 << 30
TASK_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= SPREAD_BELOW:
        return df
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, n // TASK_BYTES))


def latest(df: DataFrame, keys: list[str], version: str, value: str, mark: str | None = None) -> DataFrame:
    """The latest row's value per key (a null time is earliest, ties go to the larger ``mark``, the checksum of the value if there is none)."""
    v = F.coalesce(F.col(version).cast("timestamp").cast("double"), F.lit(float("-inf")))
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(v, F.col(mark) if mark else F.xxhash64(value))).alias(value))
