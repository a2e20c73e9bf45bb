"""Operator 2: token-id files of patched frame-of-reference blocks, and their reader.

Documents are encoded where they are read; only their packed ids move, once, to the file of their id range. A file is
one partition of a Parquet table: rows of whole segments, in ascending doc_id order. A segment is
`<u4 magic><u4 documents>`, the doc_ids (<i8, with a null flag byte each), the documents' sizes (<u4) and the documents
as `packing` lays them out; the row beside it says in which file it stands and which ids of the file come before it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fourfold.llm import packing
from fourfold.llm.common import mapped, scratch_path, slices, text_of
from fourfold.llm.encoders import encoder

MAGIC = 0x31474553
#: Ids after which a segment ends; a longer document stands alone in one.
SEGMENT = 1 << 18
#: Files at most; the ranges' bounds are a list of that many numbers on the driver.
MOST_FILES = 100_000


def bounds(docs: DataFrame, doc_id: str, files: int) -> list[int]:
    """Ids that cut the documents into about equal ranges, one less than files."""
    if files < 2:
        return []
    shares = [k / files for k in range(1, files)]
    cuts = docs.select(F.percentile_approx(F.col(doc_id).cast("long"), shares, max(10_000, 20 * files))).first()[0]
    return sorted(set(cuts or []))


def write_token_files(docs: DataFrame, vocabulary: str, out: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the ids of every whole text, `end_id` after each, to `out` in ascending doc_id order.

    Null texts are empty documents: their end id alone. Rows with a null id come first. Repeated ids stand next to each
    other, by their packed bytes. An empty table gives an empty folder of files. Other columns are not read.
    """
    files = min(MOST_FILES, max(1, docs.rdd.getNumPartitions()))
    cuts = np.array(bounds(docs, doc_id, files), np.int64)

    def pack(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found = encoder(vocabulary).ids(part.column(1).to_pylist())
                ended = [np.append(x, np.uint32(end_id)) for x in found]
                ids = part.column(0)
                file = np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
                columns = [pa.array(file, pa.int32()), ids, pa.array([len(x) for x in ended], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packing.encode(ended), pa.binary())], names=["file", "doc_id", "n_tokens", "ids"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    encoded = mapped(read, pack, "file int, doc_id long, n_tokens long, ids binary", encodes=True)
    dealt = encoded.repartitionById(len(cuts) + 1, "file").sortWithinPartitions("file", F.asc_nulls_first("doc_id"), "ids")
    mapped(dealt, segments, "file int, segment int, start long, n_tokens long, data binary").write.parquet(out)


def segments(batches):
    """Rows (file, doc_id, n_tokens, ids), in order, as whole segments."""
    held, size, at = [], 0, {"file": None, "segment": 0, "start": 0}

    def closed():
        row = [[at["file"]], [at["segment"]], [at["start"]], [size], [segment(held)]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        at["segment"] += 1
        at["start"] += size
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["file", "segment", "start", "n_tokens", "data"])

    for batch in batches:
        for file, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (file != at["file"] or size + n > SEGMENT):
                yield closed()
                held, size = [], 0
            if file != at["file"]:
                at = {"file": file, "segment": 0, "start": 0}
            held.append((doc_id, ids))
            size += n
    if held:
        yield closed()


def segment(documents: list[tuple[int | None, bytes]]) -> bytes:
    head = np.array([MAGIC, len(documents)], "<u4").tobytes()
    ids = np.array([0 if i is None else i for i, _ in documents], "<i8").tobytes()
    null = np.array([i is None for i, _ in documents], np.uint8).tobytes()
    sizes = np.array([len(d) for _, d in documents], "<u4").tobytes()
    return b"".join([head, ids, null, sizes, *(d for _, d in documents)])


def of_segment(data: bytes) -> tuple[list[int | None], list[bytes]]:
    magic, n = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    ids = np.frombuffer(data, "<i8", n, 8).tolist()
    null = np.frombuffer(data, np.uint8, n, 8 + 8 * n)
    sizes = np.frombuffer(data, "<u4", n, 8 + 9 * n)
    ends = 8 + 13 * n + np.cumsum(sizes, dtype=np.int64)
    return [None if x else i for i, x in zip(ids, null)], [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit numbers.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = totals.select("file", before.alias("before"))  # a row for each file, MOST_FILES at most
    out = "file int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def unpack(batches):
        for batch in batches:
            for file, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, documents = of_segment(data)
                ids = packing.decode(documents)
                n = np.array([len(x) for x in ids], np.int64)
                columns = [
                    pa.array(np.full(len(n), file), pa.int32()),
                    pa.array(start + np.cumsum(n) - n, pa.int64()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = ["file", "at", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    documents = mapped(stored.select("file", "start", "data"), unpack, out)
    more = ["ids"] if with_ids else []
    return documents.join(files, "file").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *more)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to the shared folder and returns what the files say of each document."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write_token_files(docs, vocabulary, out, end_id)
    return read_token_files(spark, out, with_ids=False)
