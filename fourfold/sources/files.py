"""Stores as Parquet: versions of the quads, each in one or more sorted layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.plans.layouts import checked
from fourfold.schema import QUAD, column_of


def layout_name(layout: Sequence[str]) -> str:
    return "".join(column_of(n) for n in layout)


def write_layouts(quads: DataFrame, path: str, layouts: Sequence[Sequence[str]]) -> None:
    """A copy of the quads for each layout, ranged by its first components and sorted by all, so that a lookup of a prefix
    skips all row groups but a few. Graphs may be many or hot, so they make no folders; ranges split a hot graph."""
    for layout in checked(layouts):
        columns = [column_of(n) for n in layout]
        quads.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(f"{path}/{layout_name(layout)}")


#: The sorted copies of the quoted triples: by key for joins with quads, and by what a pattern may bind.
QUOTED_LAYOUTS = (("k",), ("s", "p", "o"), ("p", "o", "s"), ("o", "s", "p"))


def quoted_layout(bound: Sequence[str]) -> tuple[str, ...]:
    """The copy whose order starts with most of the bound columns; the one by key if none is bound."""
    prefix = lambda x: next((n for n, c in enumerate(x) if c not in bound), len(x))
    return max(QUOTED_LAYOUTS, key=lambda x: (prefix(x), -QUOTED_LAYOUTS.index(x)))


def write_quoted(quoted: DataFrame, path: str) -> None:
    for columns in QUOTED_LAYOUTS:
        quoted.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(f"{path}/quoted_{''.join(columns)}")


def read_layout(spark: SparkSession, path: str, layout: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{path}/{layout_name(layout)}").select(*QUAD)


def read_quoted(spark: SparkSession, path: str) -> dict[tuple[str, ...], DataFrame]:
    return {x: spark.read.parquet(f"{path}/quoted_{''.join(x)}").select("k", "s", "p", "o") for x in QUOTED_LAYOUTS}


def without_nulls(quads: DataFrame) -> DataFrame:
    """The rows, checked as they are read: a null raises, as no column of a quad may be null."""
    fail = lambda c: F.raise_error(F.lit(f"a quad has no {c}"))
    return quads.select(*(F.coalesce(F.col(c), fail(c)).alias(c) for c in quads.columns))
