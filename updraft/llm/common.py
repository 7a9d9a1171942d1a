"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.session import ensure_checkpoint_dir

#: A batch handed to Python stays below these, so that very long texts stay within a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Rows of a batch that are Python objects at once.
SLICE_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batch_rows(df: DataFrame, row: Callable[..., tuple], schema: str) -> DataFrame:
    """``row(*values)`` applied to each row of ``df`` in Arrow batches; one output row each.

    ``row`` must be importable, so that per-process caches in its module live as
    long as the Python worker.
    """
    small_batches(df.sparkSession)
    names = df.columns
    target = arrow_schema(df.sparkSession, schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
                out = [row(*values) for values in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return df.mapInArrow(batches, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of flat or array columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def whole_text(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: a lineage cut that keeps statistics."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
