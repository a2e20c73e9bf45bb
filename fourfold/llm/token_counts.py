"""Operator 1: token counts. Arrow batches go to Python, only the lengths come back; nothing is shuffled."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import mapped, slices, text_of
from fourfold.llm.encoders import encoder

OUT = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Rows with a null or repeated id each give a row. Texts of any length
    are counted whole; a worker holds a few MB of them as strings at once. An empty table gives an empty table, and
    columns besides the two named are neither read nor returned.
    """

    def lengths(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                sizes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(encoder(path).lengths(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return mapped(read, lengths, OUT, encodes=True).withColumn("over_limit", F.col("n_tokens") > limit)
