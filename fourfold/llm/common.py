"""What the operators of this subpackage share: Arrow slices, checkpoints and column selection."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.folders import checkpointed, scratch_path

__all__ = ["BATCH_BYTES", "SLICE_BYTES", "checkpointed", "give_back", "mapped", "scratch_path", "slices", "table", "text_of"]

#: Bytes of an Arrow batch, and of the text that a Python worker holds as Python strings at once.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Zero-copy slices of `batch` whose `column` holds about `limit` bytes each; a longer value stands alone."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    yield batch.slice(first)


def mapped(df: DataFrame, function, schema, encodes: bool = False) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES, in workers that give back what they no longer need.

    The bound is a setting of the session, which Spark reads when the rows are, so it stays set.
    Workers outlive their tasks. Only a function that `encodes` finds the encoder that its worker has kept; others start
    without it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        if not encodes:
            from fourfold.llm import encoders

            encoders.forget()
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system where the C library can."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_of(column: str = "text"):
    """The column as text in which null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
