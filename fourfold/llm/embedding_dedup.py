"""Operator 6: near-duplicate vectors by collision-counting projections.

Counting window collisions of one-dimensional projections over all pairs grows with the square of the rows, so it is done
inside the cells of a few sign tables, whose number is set so that a pair at the threshold shares some cell with the
wanted probability. In a cell every vector is projected on many random lines; along each sorted line a window centred on
the query holds what collides with it. Pairs that collide on enough lines, a number that a pair at the threshold reaches
with the wanted probability, are verified by their exact cosine. A pair is reported in the first table that unites it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import checkpointed, mapped
from fourfold.llm.components import components

#: Distinct vectors that a cell should hold, and that one task compares at most; larger cells are dealt out in pairs of blocks.
CELL, TOGETHER = 1024, 4096
LINES, HALF_WINDOW = 24, 2.0
#: Pairs verified at once.
PAIRS = 1 << 16


def enough(lines: int, missed: float) -> int:
    """The count of windows that a pair at the threshold reaches but for a share `missed`."""
    p = math.erf(HALF_WINDOW / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > missed:
            return k
    return lines


def tables(vectors: int, least: float, missed: float) -> tuple[int, int]:
    """Sign bits of a cell, and tables: so many that a pair at the threshold shares a cell but for a share `missed`."""
    bits = max(0, math.ceil(math.log2(max(1, vectors) / CELL)))
    together = (1 - math.acos(least) / math.pi) ** bits
    return bits, 1 if together >= 1 else math.ceil(math.log(missed) / math.log(1 - together))


def lines_of(dimensions: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions, count]).standard_normal((dimensions, count))


def cells_of(unit: np.ndarray, bits: int, count: int, seed: int) -> np.ndarray:
    """The cell of each vector in each table."""
    if not bits:
        return np.zeros((len(unit), count), np.int64)
    signs = (unit @ lines_of(unit.shape[1], bits * count, seed) > 0).reshape(len(unit), count, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def units(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square is infinite or zero
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def colliding(unit: np.ndarray, least: float, missed: float, seed: int) -> np.ndarray:
    """Bit matrix (rows of bytes, lowest bit first): pairs that collide on enough lines.

    Along a line the vectors before each rank are a bit set, a window is two of them apart, and the counts of all pairs
    are kept as planes of bits.
    """
    n = len(unit)
    need, planes = enough(LINES, missed), LINES.bit_length()
    start = (1 << planes) - need
    size = -(-n // 8)
    counts = [np.full((n, size), 255 if start >> k & 1 else 0, np.uint8) for k in range(planes)]
    reached = np.zeros((n, size), np.uint8)
    width = HALF_WINDOW * math.sqrt(2 - 2 * least) * (1 + 1e-9)
    at = unit @ lines_of(unit.shape[1], LINES, seed + 1)
    for k in range(LINES):
        order = np.argsort(at[:, k], kind="stable")
        line = at[order, k]
        before = np.zeros((n + 1, size), np.uint8)
        before[np.arange(1, n + 1), order // 8] = (1 << (order % 8)).astype(np.uint8)
        np.bitwise_xor.accumulate(before, axis=0, out=before)
        low, high = np.searchsorted(line, at[:, k] - width, "left"), np.searchsorted(line, at[:, k] + width, "right")
        carry = before[high] ^ before[low]
        for plane in counts:
            both = plane & carry
            plane ^= carry
            carry = both
        reached |= carry
    return reached


def linked(unit: np.ndarray, ids: np.ndarray, sizes: np.ndarray, own: np.ndarray, across: bool, table: int, cells: np.ndarray, least: float, missed: float, seed: int):
    """(id, links, root) of the vectors of one cell that have links whose first shared table is this one."""
    n = len(unit)
    reached = colliding(unit, least, missed, seed)
    links, root = np.zeros(n, np.int64), np.arange(n)
    pairs = []
    for first in range(0, n, 256):
        some = np.unpackbits(reached[first : first + 256], axis=1, bitorder="little", count=n)
        row, col = np.nonzero(some)
        row += first
        ahead = col > row
        if across:
            ahead &= own[row] != own[col]
        row, col = row[ahead], col[ahead]
        for k in range(0, len(row), PAIRS):
            a, b = row[k : k + PAIRS], col[k : k + PAIRS]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
            a, b = a[near], b[near]
            new = (cells[a] == cells[b]).argmax(axis=1) == table
            a, b = a[new], b[new]
            if not len(a):
                continue
            links += np.bincount(a, sizes[b], n).astype(np.int64) + np.bincount(b, sizes[a], n).astype(np.int64)
            pairs.append(spanning(a, b, n))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        root = roots(a, b, n)
    some = links > 0
    return ids[some], links[some], ids[root[some]]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest of its component: n at most."""
    label = roots(a, b, n)
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def vectors_of(frame: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, str]:
    """(vec_id, data): the vector's numbers as bytes; null for vectors and rows that link with nothing."""
    kind = "<f4" if "array<float>" in frame.schema[vector].dataType.simpleString() else "<f8"

    def checked(batches):
        for batch in batches:
            ids, lists = batch.columns
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(kind)  # null numbers are NaN
            counted = lambda which: np.diff(np.concatenate([[0], np.cumsum(which)])[ends])
            fit = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            fit &= (counted(~np.isfinite(values)) == 0) & (counted(values != 0) > 0)
            size = np.dtype(kind).itemsize
            buffers = [np.packbits(fit, bitorder="little"), (ends * size).astype(np.int32), values]
            data = pa.Array.from_buffers(pa.binary(), len(fit), [pa.py_buffer(x.tobytes()) for x in buffers])
            yield pa.RecordBatch.from_arrays([ids, data], names=["vec_id", "data"])

    cast = "array<float>" if kind == "<f4" else "array<double>"
    read = frame.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(cast).alias("vec"))
    return mapped(read, checked, "vec_id long, data binary"), kind


def near_vectors(frame: DataFrame, least: float = 0.95, missed: float = 5e-4, seed: int = 6, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """Per row: vec_id, n_links (other vectors at a cosine of `least` or more), component_id (the smallest vec_id reachable,
    itself included), kept (vec_id = component_id).

    A pair at the threshold is missed with a probability of 2 `missed` at most, nearer ones far less; none below it is
    linked, as cosines are computed in double precision. Equal vectors are one class, whose size counts. Vectors that are
    null, empty, zero or hold null or non-finite numbers, and rows with a null id, link with nothing; vectors of different
    lengths don't link. Rows that share an id count as vectors of their own and get the sum of their links. A cell of more
    than TOGETHER classes is split into blocks that meet pair by pair in tasks of their own. Of the linked pairs only
    counts and a spanning forest leave a task. An empty table gives an empty result; other columns are not read.
    """
    read, kind = vectors_of(frame, vector, vec_id)
    read = checkpointed(read)
    classes = checkpointed(read.where("data is not null").groupBy("data").agg(F.min("vec_id").alias("id"), F.count("*").alias("size")))
    bits, count = tables(classes.count(), least, missed)
    codes = cell_codes(classes, kind, bits, count, seed)
    hot = checkpointed(codes.groupBy("table", "cell").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER))
    rows = codes.withColumns({"own": F.lit(0), "block": F.lit(0), "blocks": F.lit(1)})
    if not hot.isEmpty():
        blocks = F.ceil(F.col("n") / TOGETHER).cast("int")
        split = codes.join(hot, ["table", "cell"]).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("data"), blocks).cast("int")})
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least("own", k) * F.col("blocks") + F.greatest("own", k))
        split = split.withColumn("block", F.explode(pairs)).select(*rows.columns)
        rows = rows.join(hot, ["table", "cell"], "left_anti").select(*rows.columns).union(split)

    def search(batches):
        for group in groups(batches, 3):
            table, blocks, block = int(group["table"][0]), int(group["blocks"][0]), int(group["block"][0])
            lengths = np.array([len(x) for x in group["data"]])
            for length in np.unique(lengths):
                some = np.flatnonzero(lengths == length)
                unit = units([group["data"][k] for k in some], kind)
                numbers = (np.array(group[c])[some] for c in ("id", "size", "own"))
                cells = cells_of(unit, bits, count, seed)
                found = linked(unit, *numbers, block // blocks != block % blocks, table, cells, least, missed, seed)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "root"])

    dealt = rows.select("table", "cell", "block", "blocks", "own", "id", "size", "data").repartition("table", "cell", "block")
    found = mapped(dealt.sortWithinPartitions("table", "cell", "block"), search, "id long, links long, root long")
    found = checkpointed(found)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found, "id", "root").select(F.col("node").alias("id"), "component")
    of_class = classes.join(sums, "id", "left").join(grouped, "id", "left")
    of_class = of_class.select("data", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = read.join(of_class, "data", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def cell_codes(classes: DataFrame, kind: str, bits: int, count: int, seed: int) -> DataFrame:
    """Each class once per table: table, cell, id, size, data."""

    def coded(batches):
        for batch in batches:
            data, ids, sizes = (c.to_pylist() for c in batch.columns)
            for length in sorted({len(x) for x in data}):
                some = [k for k, x in enumerate(data) if len(x) == length]
                cells = cells_of(units([data[k] for k in some], kind), bits, count, seed)
                for table in range(count):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), table), pa.int32()),
                            pa.array(cells[:, table], pa.int64()),
                            pa.array([ids[k] for k in some], pa.int64()),
                            pa.array([sizes[k] for k in some], pa.int64()),
                            pa.array([data[k] for k in some], pa.binary()),
                        ],
                        names=["table", "cell", "id", "size", "data"],
                    )

    return mapped(classes.select("data", "id", "size"), coded, "table int, cell long, id long, size long, data binary")


def groups(batches, keys: int):
    """Runs of rows that agree in the first `keys` columns, as lists by column name."""
    held, key = None, None
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
        marks = list(zip(*list(columns.values())[:keys]))
        first = 0
        for k in range(1, len(marks) + 1):
            if k == len(marks) or marks[k] != marks[first]:
                part = {n: c[first:k] for n, c in columns.items()}
                if held is not None and marks[first] == key:
                    for n in held:
                        held[n] += part[n]
                else:
                    if held is not None:
                        yield held
                    held, key = part, marks[first]
                first = k
    if held is not None:
        yield held
