"""Operator 5: mixing sources to target weights with a hierarchical token budget.

Leaves are the distinct values of the level columns, from the root's children down, such as (domain, language, source).
A node's budget is shared among its children by their weights. A child that has too few tokens, all epochs counted, gives
back what it cannot use, which its siblings get by their weights; only what a whole subtree cannot use goes further up.
A leaf's budget buys whole epochs and then a prefix of one more, in that epoch's seeded order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourfold.llm.common import checkpointed, mapped, slices, text_of
from fourfold.llm.encoders import encoder

#: Leaves at most: the tree is solved on the driver and sent to every task.
MOST_LEAVES = 200_000
NONE = "\\N"
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Plan:
    """What is taken of a leaf: `epochs` whole ones, and of the next the rows up to (hash, key)."""

    path: tuple[str, ...]
    available: int
    budget: int
    epochs: int
    hash: int
    key: int


def shared(total: int, wants: list[tuple[float, int]]) -> list[int]:
    """`total` dealt out by weight, none over its capacity; what one cannot use is dealt out again to the others.

    wants: (weight, capacity). Children of weight 0 get nothing unless all others are full.
    """
    out, rest = [0] * len(wants), total
    for weighted in (True, False):
        open_ = [k for k, (w, c) in enumerate(wants) if (w > 0) == weighted and c > out[k]]
        while rest > 0 and open_:
            sum_ = sum(wants[k][0] if weighted else 1 for k in open_)
            part = {k: int(rest * (wants[k][0] if weighted else 1) / sum_) for k in open_}
            full = [k for k in open_ if out[k] + part[k] >= wants[k][1]]
            if not full:
                for k in open_:
                    out[k] += part[k]
                rest -= sum(part.values())
                for k in sorted(open_, key=lambda k: (-wants[k][0], k)):  # what rounding left
                    more = min(rest, wants[k][1] - out[k])
                    out[k] += more
                    rest -= more
                break
            for k in full:
                rest -= wants[k][1] - out[k]
                out[k] = wants[k][1]
            open_ = [k for k in open_ if k not in set(full)]
    return out


def budgets(leaves: Mapping[tuple[str, ...], int], total: int, weight: Callable[[tuple[str, ...]], float], epochs: int) -> dict[tuple[str, ...], int]:
    """The budget of each leaf, from its tokens; `weight` has the weight of each node by its path."""
    inside: dict[tuple[str, ...], int] = {}
    below: dict[tuple[str, ...], set] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            inside[path[:depth]] = inside.get(path[:depth], 0) + tokens * epochs
            if depth:
                below.setdefault(path[: depth - 1], set()).add(path[:depth])
    out, waiting = {}, [((), min(total, inside.get((), 0)))]
    while waiting:
        path, budget = waiting.pop()
        children = sorted(below.get(path, ()))
        if not children:
            if path:
                out[path] = budget
            continue
        waiting += zip(children, shared(budget, [(weight(c), inside[c]) for c in children]))
    return out


def order(seed: int, epoch: Column) -> Column:
    """A row's place in its leaf's epoch: every epoch has an order of its own."""
    return F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), F.col("key"))


def mixture(counted: DataFrame, levels: list[str], weight: Callable[[tuple[str, ...]], float], share: float, epochs: int = 1, seed: int = 17) -> list[Plan]:
    """The plan of every leaf of `counted` (key, n_tokens and the levels, none null).

    The total is `share` of all tokens. A leaf's last epoch is cut by two rounds of sums over 4,096 ranges of its order, and
    only the rows of the last range, a 16-millionth of the leaf, are put in order; ranges are summed before they move.
    """
    sums = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    leaves = {tuple(r[:-1]): int(r[-1]) for r in sums}
    goal = budgets(leaves, int(share * sum(leaves.values())), weight, epochs)
    whole = {p: goal[p] // t if t else 1 for p, t in leaves.items()}  # a leaf without tokens costs nothing
    rest = {p: goal[p] - whole[p] * t if t else 0 for p, t in leaves.items()}
    cut = {p: (LOWEST, LOWEST) for p in leaves}  # nothing of the last epoch
    open_ = {p: (r, -1, -1) for p, r in rest.items() if r > 0}
    spark = counted.sparkSession
    fields = ", ".join(f"{c} string" for c in levels)
    for depth, shift in ((0, 52), (1, 40)):
        if not open_:
            break
        rows = [(*p, whole[p], r, a) for p, (r, a, _) in open_.items()]
        frame = F.broadcast(spark.createDataFrame(rows, f"{fields}, epoch long, rest long, top long"))  # MOST_LEAVES rows at most
        hashed = counted.join(frame, levels).withColumn("h", order(seed, F.col("epoch")))
        if depth:
            hashed = hashed.where(F.shiftright("h", 52) == F.col("top"))
        ranges = hashed.groupBy(*levels, F.shiftright("h", shift).alias("range")).agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
        upto = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("range"))
        over = ranges.withColumn("upto", upto).where("upto > rest").groupBy(*levels).agg(F.min(F.struct("range", "upto", "tokens")).alias("x"))
        found = {tuple(r[: len(levels)]): (r["x"][0], r["x"][1] - r["x"][2]) for r in over.collect()}
        open_ = {p: (r - found[p][1], found[p][0], 0) for p, (r, *_) in open_.items()}
    if open_:
        rows = [(*p, whole[p], r, a) for p, (r, a, _) in open_.items()]
        frame = F.broadcast(spark.createDataFrame(rows, f"{fields}, epoch long, rest long, top long"))
        last = counted.join(frame, levels).withColumn("h", order(seed, F.col("epoch"))).where(F.shiftright("h", 40) == F.col("top"))
        upto = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("h", "key"))  # rows of one key stand together
        fit = last.withColumn("upto", upto).where("upto <= rest").groupBy(*levels).agg(F.max(F.struct("h", "key")).alias("x"))
        found = {tuple(r[: len(levels)]): tuple(r["x"]) for r in fit.collect()}
        for p, (_, top, _) in open_.items():
            cut[p] = found.get(p, (top << 40, LOWEST))  # no row of the range
    return [Plan(p, leaves[p], goal[p], whole[p], *cut[p]) for p in sorted(leaves)]


def chosen(rows: DataFrame, levels: list[str], plans: list[Plan], seed: int = 17) -> DataFrame:
    """`rows` (key, the levels and any others), once per epoch that takes them, with the column epoch (from 0)."""
    fields = ", ".join(f"{c} string" for c in levels)
    data = [(*p.path, p.epochs, p.hash, p.key) for p in plans]
    frame = F.broadcast(rows.sparkSession.createDataFrame(data, f"{fields}, whole long, cut_hash long, cut_key long"))  # MOST_LEAVES rows at most
    h = order(seed, F.col("whole"))
    partly = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col("key") <= F.col("cut_key")) & (F.col("cut_key") > LOWEST))
    n = F.col("whole") + partly.cast("long")
    each = F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    return rows.join(frame, levels).withColumn("epoch", each).drop("whole", "cut_hash", "cut_key")


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row's place in its leaf depends on: its id, or its text where that is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.greatest(F.xxhash64(text_of(text)), F.lit(LOWEST + 1)))


def keyed(docs: DataFrame, levels: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """`docs` with the columns key and those of the levels, none null."""
    named = {name: F.coalesce(c.cast("string"), F.lit(NONE)) for name, c in levels.items()}
    return docs.withColumns({"key": key_of(doc_id), **named})


def mix(docs: DataFrame, levels: dict[str, Column], weight: Callable[[tuple[str, ...]], float], vocabulary: str, share: float, epochs: int = 1, seed: int = 17, whole_rows: bool = False) -> DataFrame:
    """Which rows of `docs` are taken, and in which epoch: doc_id, the levels, n_tokens, epoch; or the rows themselves.

    `levels` names each level of the tree with its column. Nulls of a level are a group of their own (\\N). Null and empty
    texts have 0 tokens and are taken if their place is before the cut. Rows that share an id in a leaf are taken together;
    rows with a null id go by their text, equal texts together. What rounding leaves goes to the heaviest child, of equal weights to the
    first by name; rows of a leaf whose hashes are equal follow by id. A leaf's prefix ends before the row that would exceed its budget. An empty
    table gives an empty result. With `whole_rows` the result has the columns of `docs` alone, which may be called
    anything; a row stands there once for each epoch that takes it.
    """
    names = [f"_level_{k}" for k in range(len(levels))]
    own = {n: c for n, c in zip(names, levels.values())}
    plain = keyed(docs.select("doc_id", "text", *(c.alias(n) for n, c in own.items())), {n: F.col(n) for n in names})
    counted = checkpointed(token_table(plain, vocabulary, names))
    plans = mixture(counted, names, weight, share, epochs, seed)
    if whole_rows:
        leaf = (F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in own.items())
        rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *leaf, key_of().alias("key"))
        taken = chosen(rows, names, plans, seed)
        return taken.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
    taken = chosen(counted, names, plans, seed)
    return taken.select("doc_id", *(F.col(n).alias(name) for n, name in zip(names, levels)), "n_tokens", "epoch")


def token_table(plain: DataFrame, vocabulary: str, names: list[str]) -> DataFrame:
    """doc_id, key, the levels and n_tokens of every row, without the text."""

    def lengths(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                n = encoder(vocabulary).lengths(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=["doc_id", "key", *names, "n_tokens"])

    read = plain.select(F.col("doc_id").cast("long").alias("doc_id"), "key", *names, text_of().alias("text"))
    fields = "".join(f"{n} string, " for n in names)
    return mapped(read, lengths, f"doc_id long, key long, {fields}n_tokens long", encodes=True)
