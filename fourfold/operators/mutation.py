"""Changing sets of quads.

The functions give the new set and what a single change does to it. `Quads` is what a store holds: a base and the changes
since, each a frame of its own, so that a change lengthens the plan by the rows that it brings and by nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.operators.matching import QuotedRows, equal, find_quoted, match
from fourfold.plans.pattern import Pattern
from fourfold.schema import QUAD


@dataclass(frozen=True)
class Change:
    """quads: the set afterwards. changed: the quads that were new, or that are gone."""

    quads: DataFrame
    changed: DataFrame


def checked(rows: DataFrame) -> DataFrame:
    """The four columns of `rows`; the schema is fixed."""
    missing = [c for c in QUAD if c not in rows.columns]
    if missing:
        raise ValueError(f"quads lack the columns {', '.join(missing)}")
    return rows.select(*QUAD)


def fitting(quads: DataFrame, quoted: QuotedRows, pattern: Pattern, fits: bool) -> DataFrame:
    """The rows that the pattern fits, or all others; any further columns stay. One reference to `quads`, whatever the
    pattern: quoted patterns are left joins on distinct keys."""
    columns, flags = quads.columns, [equal(pattern.constants)]
    for k, (c, inner) in enumerate(pattern.quoted.items()):
        keys = find_quoted(quoted, inner).select(F.col("k").alias(f"found_{k}")).distinct()
        quads = quads.join(keys, quads[c] == keys[f"found_{k}"], "left")
        flags.append(F.col(f"found_{k}").isNotNull())
    flag = reduce(lambda a, b: a & b, flags)
    return quads.where(flag if fits else ~flag).select(*columns)


@dataclass(frozen=True)
class Quads:
    """A set: `base`, changed by `log` (s, p, o, g, seq, added); of a quad's changes the one with the highest seq counts."""

    base: DataFrame
    log: DataFrame | None = None
    changes: int = 0

    def on(self, base: DataFrame) -> DataFrame:
        """The set as it is now, with another copy of the base. A small log is broadcast by Spark, so the base stays put."""
        if self.log is None:
            return base
        latest = self.log.groupBy(*QUAD).agg(F.max(F.col("seq") * 2 + F.col("added").cast("int")).alias("last"))
        kept = base.join(self.log.select(*QUAD), list(QUAD), "left_anti")
        return kept.unionByName(latest.where("last % 2 = 1").select(*QUAD))

    @property
    def now(self) -> DataFrame:
        return self.on(self.base)

    def logged(self, rows: DataFrame, added: bool) -> Quads:
        rows = checked(rows).withColumns({"seq": F.lit(self.changes + 1), "added": F.lit(added)})
        return Quads(self.base, rows if self.log is None else self.log.unionByName(rows), self.changes + 1)

    def without(self, quoted: QuotedRows, pattern: Pattern) -> Quads:
        """Without what the pattern fits: a filter of the base and of the log."""
        kept = lambda frame: frame if frame is None else fitting(frame, quoted, pattern, False)
        return replace(self, base=kept(self.base), log=kept(self.log), changes=self.changes + 1)


def add(quads: DataFrame, rows: DataFrame) -> Change:
    """With the rows that are not there yet, each once."""
    new = checked(rows).distinct().join(quads, list(QUAD), "left_anti")
    return Change(quads.unionByName(new), new)


def remove(quads: DataFrame, rows: DataFrame) -> Change:
    """Without the rows; those that are not there change nothing."""
    rows = checked(rows)
    return Change(quads.join(rows, list(QUAD), "left_anti"), quads.join(rows, list(QUAD), "left_semi"))


def remove_matches(quads: DataFrame, quoted: QuotedRows, pattern: Pattern) -> Change:
    """Without the quads that the pattern fits."""
    return Change(fitting(quads, quoted, pattern, False), match(quads, quoted, pattern))


def delete_graph(quads: DataFrame, key: str) -> Change:
    return Change(quads.where(quads["g"] != key), quads.where(quads["g"] == key))


def add_quoted(quoted: DataFrame, rows: DataFrame) -> DataFrame:
    """With the quoted triples that are not there yet. They stay when quads that hold them go."""
    return quoted.unionByName(rows.select("k", "s", "p", "o")).distinct()
