"""Operator 4: SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius + 1 bits, and every non-zero vector v of that size gives a mask: the
bits whose vector has an odd product with v. The vectors of `radius` bits span less than the whole space, so some v is
orthogonal to all of them: two fingerprints that differ in these bits agree under its mask. Every pair within the radius
thus meets in some bucket; a pair that meets is compared exactly.

A fingerprint of shingles moves by far more than a few bits between near copies of a similarity of 0.8, so the groups of
`one_of_each_group` add links between similar sketches of the texts' five-word shingles. Every distinct sketch is a node; those
that agree in a band of the sketch meet and are compared whole, before links are thinned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import checkpointed, mapped, slices, text_of
from fourfold.llm.components import components

SEED = 42
#: Hashes whose bits are counted at once.
HASHES = 1 << 16
#: Distinct fingerprints of a bucket that one task compares; larger buckets are dealt out in pairs of blocks.
TOGETHER = 1 << 15
#: Of so many fingerprints one is looked at to find such buckets.
LOOKED_AT = 64
#: The sketch's bins; the least share of equal bins: a similarity of 0.8 less 1.4 standard errors of the sketch.
BINS, LEAST_EQUAL = 128, 0.75
#: Bins of a band, which make a long. Sketches with 96 of 128 bins in common share none of the 32 bands once in 200,000 times.
BAND = 4
#: Texts of so many distinct shingles or fewer are similar only if they have all of them in common.
ALL_SHARED = 4
#: As TOGETHER, for sketches.
SKETCHES_TOGETHER = 1 << 13
#: Fixed odd numbers that mix hashes.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Up to this size all links of a bucket are given, beyond it a spanning forest of them.
FEW = 32


def hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it is shorter."""
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), "<u8", len(starts))


def majority(some: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(some), HASHES):
        bits = np.unpackbits(some[k : k + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(some), bitorder="little").view("<u8")[0])


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased A-Z, split at the six ASCII white spaces, as bytes do."""
    return text.lower().split()


def fingerprint(text: bytes, words: int = 4) -> int:
    """The bits set in over half the XXH64 hashes of the shingles; 0 if there is no word."""
    found = words_of(text)
    return majority(hashes(found, words)) if found else 0


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", doc_id: str = "doc_id", sketched: bool = False) -> DataFrame:
    """Per row: doc_id, fp (the 64 bits as a long); if sketched, sketch, null for texts without a word."""

    def prints(batches):
        for batch in batches:
            for part in slices(batch, 1):
                fps, sketches = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    found = words_of(text)
                    some = hashes(found, words) if found else np.empty(0, "<u8")
                    fps.append(majority(some) if found else 0)
                    if sketched:
                        sketches.append(sketch(some) if found else None)
                columns = [part.column(0), as_longs(fps), *[pa.array(sketches, pa.binary())] * sketched]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sketch"][: len(columns)])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return mapped(read, prints, "doc_id long, fp long" + ", sketch binary" * sketched)


def as_longs(values: list[int | None]) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def sketch(some: np.ndarray) -> bytes:
    """The least hash of each of BINS bins, 16 bits each, over the distinct shingles of one word more than those hashed: two
    that follow each other are one such shingle. All bits stand for an empty bin. Then 64 bits that tell all shingles of a text
    of ALL_SHARED or fewer, 0 for others."""
    longer = (some[:-1] * MIX_A ^ (some[1:] + MIX_A) * MIX_B) * MIX_A if len(some) > 1 else some * MIX_A
    longer ^= longer >> np.uint64(29)
    longer *= MIX_B
    low = np.full(BINS, 0xFFFF, "<u2")
    np.minimum.at(low, (longer >> np.uint64(57)).astype(np.int64) % BINS, ((longer >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16))
    told = np.zeros(1, "<u8")
    if (low != 0xFFFF).sum() <= ALL_SHARED and len(few := np.unique(longer)) <= ALL_SHARED:
        told[0] = few.sum() | np.uint64(1)
    return low.tobytes() + told.tobytes()


def masks(radius: int) -> list[int]:
    """The covering masks, 2**(radius + 1) - 2 of them, as signed longs.

    All bits' vectors have the top bit set, the rest count up; so each product with a v that isn't the top bit alone is odd
    for half the bits, and every mask keeps 32. That one v gives the mask of all bits, under which no two distinct
    fingerprints agree, and is left out.
    """
    if not 0 < radius <= 6:
        raise ValueError("masks of 64 bits cover a radius from 1 to 6")
    top = 1 << radius
    of_bit = [top | k % top for k in range(64)]
    found = [sum(1 << k for k, x in enumerate(of_bit) if (x & v).bit_count() % 2) for v in range(1, 2 * top) if v != top]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the ids of `classes` (fp, id), enough to connect all that are within the radius.

    A bucket of over TOGETHER fingerprints, by an estimate, is split into blocks that meet pair by pair in tasks of their own.
    """
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)))
    rows = classes.select("fp", "id", F.posexplode(keys).alias("mask", "key"))
    looked = rows.where(F.pmod(F.xxhash64("fp"), F.lit(LOOKED_AT)) == 0).groupBy("mask", "key").agg((F.count("*") * LOOKED_AT).alias("n"))
    hot = checkpointed(looked.where(F.col("n") > TOGETHER))
    rows = rows.withColumn("block", F.lit(0))
    if not hot.isEmpty():
        blocks = F.ceil(F.col("n") / TOGETHER).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.least(own, k) * blocks + F.greatest(own, k)))
        split = rows.drop("block").join(hot, ["mask", "key"]).select("fp", "id", "mask", "key", pairs.alias("block"))
        rows = rows.join(hot, ["mask", "key"], "left_anti").select("fp", "id", "mask", "key", "block").union(split)

    def linked(batches):
        rest = None
        for batch in batches:
            here = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            here = here if rest is None else [np.concatenate(x) for x in zip(rest, here)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in here[:3]], axis=0)) + 1
            if not len(change):  # one bucket so far
                rest = here
                continue
            rest = [x[change[-1] :] for x in here]
            yield links_of([x[: change[-1]] for x in here], np.concatenate([[0], change]), radius)
        if rest is not None and len(rest[0]):
            yield links_of(rest, np.array([0, len(rest[0])]), radius)

    dealt = rows.select("mask", "key", "block", "fp", "id").repartition("mask", "key", "block")
    return mapped(dealt.sortWithinPartitions("mask", "key", "block"), linked, "a long, b long")


def links_of(columns: list[np.ndarray], edges: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links within each bucket; `edges` has where buckets begin, and the end."""
    fp, ids = columns[3].astype(np.int64).view(np.uint64), columns[4]
    size = np.diff(edges)
    a, b = [], []
    for step in range(1, min(FEW, int(size.max(initial=1)))):
        fit = (size > step) & (size <= FEW)
        if not fit.any():
            continue
        left = np.repeat(edges[:-1][fit], size[fit] - step) + ranks(size[fit] - step)
        near = np.bitwise_count(fp[left] ^ fp[left + step]) <= radius
        a.append(ids[left[near]])
        b.append(ids[left[near] + step])
    for begin, n in zip(edges[:-1][size > FEW].tolist(), size[size > FEW].tolist()):
        x, y = forest(fp[begin : begin + n], radius)
        a.append(ids[begin + x])
        b.append(ids[begin + y])
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined], names=["a", "b"])


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius: each found node is compared once with those not yet found."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        waiting, left = [left[:1]], left[1:]
        while waiting and len(left):
            found = waiting.pop()
            for node in found.tolist():
                near = np.bitwise_count(fp[left] ^ fp[node]) <= radius
                if near.any():
                    waiting.append(left[near])
                    a.append(np.full(len(waiting[-1]), node))
                    b.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Fingerprints that differ in `radius` bits or fewer are linked. Exact fingerprint copies are one class from the start,
    so a group of copies costs a row. Null and wordless texts have fingerprint zero and are linked like any other. Rows
    that share an id keep a row each. A row with a null id gets its group's component_id, null if the group has no id. An
    empty table gives an empty result; other columns are neither read nor returned.
    """
    prints = checkpointed(fingerprints(docs, words, text, doc_id))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    grouped = components(near_links(classes, radius)).select(F.col("node").alias("id"), "component")
    named = classes.join(grouped, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def as_rows(sketches: pa.Array) -> np.ndarray:
    """A row of longs for each sketch: its bands, and what tells all its shingles."""
    return np.frombuffer(b"".join(sketches.to_pylist()), "<i8").reshape(-1, BINS // BAND + 1)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sketches x and y (rows of longs) have LEAST_EQUAL of their bins in common, bins empty in both left out."""
    bins_x, bins_y = (z[..., :-1].copy().view("<u2") for z in (x, y))
    full = ((bins_x & bins_y) != 0xFFFF).sum(axis=-1)
    near = ((bins_x == bins_y) & (bins_x != 0xFFFF)).sum(axis=-1) >= LEAST_EQUAL * full
    return near & ((x[..., -1] == y[..., -1]) | (x[..., -1] == 0) | (y[..., -1] == 0))


def sketch_forest(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that are alike: each found node is compared once with those not yet found."""
    left, a, b = np.arange(len(sketches)), [], []
    while len(left):
        waiting, left = [left[:1]], left[1:]
        while waiting and len(left):
            found = waiting.pop()
            for node in found.tolist():
                near = np.concatenate([alike(sketches[left[k : k + HASHES // 8]], sketches[node]) for k in range(0, len(left), HASHES // 8)])
                if near.any():
                    waiting.append(left[near])
                    a.append(np.full(len(waiting[-1]), node))
                    b.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))


def similar_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of `classes` (sketch, id, node: a number of its own), enough to connect all sketches that
    are alike and share a band.

    A first pass without sketches finds the buckets with company. One of over SKETCHES_TOGETHER nodes is split into blocks that
    meet pair by pair in tasks of their own.
    """

    def banded(batches):
        for batch in batches:
            keys = as_rows(batch.column(1))[:, :-1]
            row, band = np.nonzero(keys != -1)
            nodes = batch.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(keys[row, band]), pa.array(nodes)], names=["band", "key", "node"])

    rows = mapped(classes.select("node", "sketch"), banded, "band int, key long, node long")
    many = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / SKETCHES_TOGETHER).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.least(own, k) * blocks + F.greatest(own, k)))
    met = rows.join(many, ["band", "key"]).select("band", "key", "node", pairs.alias("block"))

    def linked(batches):
        rest = None
        for batch in batches:
            here = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)] + [as_rows(batch.column(4))]
            here = here if rest is None else [np.concatenate(x) for x in zip(rest, here)]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in here[:3]], axis=0)) + 1
            if not len(change):  # one bucket so far
                rest = here
                continue
            rest = [x[change[-1] :] for x in here]
            yield alike_of(here[3][: change[-1]], here[4], np.concatenate([[0], change]))
        if rest is not None and len(rest[0]):
            yield alike_of(rest[3], rest[4], np.array([0, len(rest[0])]))

    dealt = met.join(classes, "node").select("band", "key", "block", "id", "sketch").repartition("band", "key", "block")
    return mapped(dealt.sortWithinPartitions("band", "key", "block"), linked, "a long, b long").distinct()


def alike_of(ids: np.ndarray, sketches: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Links within each bucket; `edges` has where buckets begin, and the end."""
    size = np.diff(edges)
    first = edges[:-1][size == 2]
    near = first[alike(sketches[first], sketches[first + 1])]
    a, b = [ids[near]], [ids[near + 1]]
    for begin, n in zip(edges[:-1][size > 2].tolist(), size[size > 2].tolist()):
        x, y = sketch_forest(sketches[begin : begin + n])
        a.append(ids[begin + x])
        b.append(ids[begin + y])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def group_links(docs: DataFrame, radius: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(links, ids): links (a, b) between documents that are near copies, and the ids that several rows have."""
    prints = checkpointed(fingerprints(docs, words, sketched=True).where("doc_id is not null"))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    own = prints.join(classes, "fp").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    sketches = prints.where("sketch is not null").groupBy("sketch").agg(F.min("doc_id").alias("id"))
    sketches = checkpointed(sketches.withColumn("node", F.monotonically_increasing_id()))
    same = prints.join(sketches, "sketch").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    repeated = prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id"))
    return near_links(classes, radius).union(own).union(same).union(similar_links(sketches)), repeated


def one_of_each_group(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """`docs`, whole rows, with one document of each group of near copies: the one with the smallest doc_id.

    Documents are linked if their fingerprints differ in `radius` bits or fewer, or if their texts' shingles of words + 1 words
    are similar, 0.8 or more but for the sketch's error. Each distinct text is compared for itself, in groups of any size.
    Rows that share an id are one document: one row of them is kept, that of the least text, then of the least other columns
    that can be ordered. Rows with a null id stay. Null and wordless texts are copies of each other. Ties go to the smallest id;
    an empty table gives an empty result; other columns may be called anything. The ids that go are joined to the documents,
    whose texts move only where that join or a repeated id needs it.
    """
    links, repeated = group_links(docs, radius, words)
    gone = checkpointed(components(links).where("node != component").select(F.col("node").alias("gone_id")))
    repeated = checkpointed(repeated)
    held = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    stay = held.join(gone, held["_id"] == gone["gone_id"], "left_anti")
    if not repeated.isEmpty():
        ordered = [F.col("_row").getField(c) for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
        again = stay.join(repeated, stay["_id"] == repeated["repeated_id"], "left_semi")
        once = again.groupBy("_id").agg(F.min_by("_row", F.struct("_text", *ordered)).alias("_row")).select("_row")
        stay = stay.join(repeated, stay["_id"] == repeated["repeated_id"], "left_anti").select("_row").unionByName(once)
    return stay.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
