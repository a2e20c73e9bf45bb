"""Reading: matches, bindings, counts, distinct terms and nodes, each as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.functions.terms import Quoted, Term, Var, open_term
from fourfold.plans.pattern import Pattern, nowhere
from fourfold.schema import NAMES, QUAD, column_of, columns_of


def equal(keys: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(k) for c, k in keys.items()), F.lit(True))


#: The quoted triples (k, s, p, o): a frame, or the frame to read for what is bound.
QuotedRows = DataFrame | Callable[[Sequence[str]], DataFrame]


def serving(quoted: QuotedRows, bound: Sequence[str]) -> DataFrame:
    return quoted if isinstance(quoted, DataFrame) else quoted(bound)


def find_quoted(quoted: QuotedRows, pattern: Quoted) -> DataFrame:
    """The rows of `quoted` that the pattern fits; names of variables don't count. Nested patterns are semi-joined."""
    if nowhere(pattern):
        return serving(quoted, ()).where(F.lit(False))
    parts = dict(zip(("s", "p", "o"), pattern.parts))
    found = serving(quoted, [c for c, t in parts.items() if not open_term(t)]).where(equal({c: t.key() for c, t in parts.items() if not open_term(t)}))
    for c, t in parts.items():
        if isinstance(t, Quoted) and t.has_variables():
            inner = find_quoted(quoted, t).select(F.col("k").alias("inner_k"))
            found = found.join(inner, found[c] == inner["inner_k"], "left_semi")
    return found


def match(quads: DataFrame, quoted: QuotedRows, pattern: Pattern) -> DataFrame:
    """The quads that the pattern fits. A variable is a wildcard whatever its name, so repeated ones are not joined."""
    found = quads.where(equal(pattern.constants))
    for c, inner in pattern.quoted.items():
        keys = find_quoted(quoted, inner).select(F.col("k").alias("quoted_k"))
        found = found.join(keys, found[c] == keys["quoted_k"], "left_semi")
    return found


def bindings(quads: DataFrame, quoted: QuotedRows, pattern: Pattern) -> DataFrame:
    """A row for each solution, a column for each variable, in order of first sight.

    Repeated variables are equal everywhere, inside quoted patterns as well. A pattern without variables gives a row without
    columns for each quad it fits: one or none.
    """
    missing = [c for c, t in pattern.positions if t is None]
    if missing:
        raise ValueError(f"bindings need a term or a variable at {', '.join(missing)}")
    if any(nowhere(t) for t in pattern.quoted.values()):
        return quads.where(F.lit(False)).select(*(F.col("s").alias(v) for v in pattern.variables))
    found = quads.where(equal(pattern.constants)).select(*(F.col(c).alias(f"t_{c}") for c in QUAD))
    seen: dict[str, str] = {}
    waiting: list[tuple[str, Term | None]] = [(f"t_{c}", t) for c, t in pattern.positions]
    for column, term in waiting:  # equalities of a quad's own positions come before any join
        if isinstance(term, Var):
            found = bound(found, seen, column, term)
    joined = 0
    while waiting:
        column, term = waiting.pop(0)
        if not isinstance(term, Quoted) or not term.has_variables():
            continue
        joined += 1
        names = {c: f"q{joined}_{c}" for c in ("k", "s", "p", "o")}
        parts = dict(zip(("s", "p", "o"), term.parts))
        fixed = [c for c, t in parts.items() if not open_term(t)]
        rows = serving(quoted, fixed or ["k"]).where(equal({c: t.key() for c, t in parts.items() if not open_term(t)})).select(*(F.col(c).alias(n) for c, n in names.items()))
        same = F.col(column) == F.col(names["k"])
        for c, t in parts.items():  # a variable known by now is part of the join
            if isinstance(t, Var) and t.name in seen:
                same &= F.col(seen[t.name]) == F.col(names[c])
        found = found.join(rows, same)
        for c, t in parts.items():
            if isinstance(t, Var):
                found = bound(found, seen, names[c], t)
            elif isinstance(t, Quoted):
                waiting.append((names[c], t))
        if isinstance(term.graph, Var):
            found = bound(found.withColumn(f"q{joined}_g", F.lit("")), seen, f"q{joined}_g", term.graph)
    return found.select(*(F.col(seen[v]).alias(v) for v in pattern.variables))


def bound(found: DataFrame, seen: dict[str, str], column: str, variable: Var) -> DataFrame:
    """`found` where the variable's columns agree; its first column is remembered."""
    if variable.name not in seen:
        seen[variable.name] = column
        return found
    return found if seen[variable.name] == column else found.where(F.col(seen[variable.name]) == F.col(column))


def count(quads: DataFrame, quoted: QuotedRows, pattern: Pattern) -> DataFrame:
    """One row: n, the exact number of quads that the pattern fits."""
    return match(quads, quoted, pattern).agg(F.count("*").alias("n"))


def distinct_terms(quads: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct combinations of the components, in the order asked for. For no component: one empty row if there is a
    quad."""
    columns = columns_of(names)
    return quads.select(*columns).distinct() if columns else quads.select().limit(1)


def count_distinct_terms(quads: DataFrame, names: Sequence[str]) -> DataFrame:
    return distinct_terms(quads, names).agg(F.count("*").alias("n"))


def layout_terms(quads: DataFrame, layout: Sequence[str], taken: Sequence[bool]) -> DataFrame:
    """The components at the taken levels of a layout, a row for each path down to its last named level.

    Paths of which all levels are taken are distinct; a path with a gap gives a row for each way through the gap.
    """
    levels = [column_of(n) for n in layout[: len(taken)]]
    rows = quads.select(*levels)
    rows = rows if len(levels) == len(QUAD) else rows.distinct()  # quads are distinct as they are
    return rows.select(*(c for c, t in zip(levels, taken) if t))


def count_layout_terms(quads: DataFrame, layout: Sequence[str], taken: Sequence[bool]) -> DataFrame:
    """The number of paths of a layout down to the last named level."""
    return layout_terms(quads, layout, taken).agg(F.count("*").alias("n"))


def nodes(quads: DataFrame, graph: Term | None = None) -> DataFrame:
    """The distinct (g, node) of terms that are subject or object in a graph; all graphs for None or a variable.

    One scan: every quad gives its two nodes, which are made distinct before and after they move.
    """
    some = quads if open_term(graph) else quads.where(F.col("g") == graph.key())
    return some.select("g", F.explode(F.array("s", "o")).alias("node")).distinct()


#: What `match_many` takes of a quoted pattern at a position: `o_s` is the subject of a triple quoted as object.
NESTED = tuple(f"{c}_{part}" for c in QUAD for part in ("s", "p", "o"))


def match_many(scan: Callable[[Sequence[str]], DataFrame], quoted: QuotedRows, patterns: DataFrame) -> DataFrame:
    """A batch of patterns at once: the rows of `patterns`, each beside every quad (s, p, o, g) that it fits.

    Of the columns s, p, o, g and those of NESTED each that is not null binds its position; all others name the pattern and
    come back. Patterns are grouped by what they bind, 2 ** 16 ways at most, and every group is one join with the copy that
    `scan` has for it, on all bound columns. A pattern that binds nothing fits every quad and is refused.
    """
    bound_by = [c for c in (*QUAD, *NESTED) if c in patterns.columns]
    names = [c for c in patterns.columns if c not in bound_by]
    shape = F.concat_ws(",", *(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in bound_by)) if bound_by else F.lit("")
    found = []
    for row in patterns.select(shape.alias("shape")).distinct().collect():
        bound = row["shape"].split(",") if row["shape"] else []
        if not bound:
            raise ValueError("a pattern that binds nothing fits every quad: use match")
        asked = patterns.where(shape == row["shape"]).select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_of"), *(F.col(c).alias(f"_{c}") for c in bound))
        plain = [c for c in bound if c in QUAD]
        for c in QUAD:
            inner = [n for n in bound if n.startswith(f"{c}_")]
            if not inner:
                continue
            parts = [n[2:] for n in inner]
            rows = serving(quoted, parts).select(F.col("k").alias(f"_k_{c}"), *(F.col(x).alias(f"_{c}_{x}") for x in parts))
            asked = asked.join(rows, [f"_{n}" for n in inner])
            plain += [] if c in plain else [c]
            asked = asked.where(F.col(f"_{c}") == F.col(f"_k_{c}")) if f"_{c}" in asked.columns else asked.withColumnRenamed(f"_k_{c}", f"_{c}")
        quads = scan([NAMES[QUAD.index(c)] for c in plain])
        same = reduce(lambda a, b: a & b, (quads[c] == asked[f"_{c}"] for c in plain))
        found.append(asked.join(quads, same).select("_of", *QUAD))
    if not found:
        found = [patterns.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_of")).join(scan([]).limit(0), F.lit(False)).select("_of", *QUAD)]
    joined = reduce(DataFrame.unionAll, found)
    return joined.select(*(F.col("_of").getField(c).alias(c) for c in names), *QUAD)


def count_many(scan: Callable[[Sequence[str]], DataFrame], patterns: DataFrame) -> DataFrame:
    """The rows of `patterns` with n, the number of quads that each fits; all bind the same of s, p, o, g, null in none.

    The quads are counted by these columns before they meet the patterns, so counts move and not quads.
    """
    bound = [c for c in QUAD if c in patterns.columns]
    if not bound:
        raise ValueError("a pattern that binds nothing fits every quad: use count")
    sums = scan([NAMES[QUAD.index(c)] for c in bound]).groupBy(*bound).agg(F.count("*").alias("n"))
    return patterns.join(sums, bound, "left").withColumn("n", F.coalesce("n", F.lit(0)))
