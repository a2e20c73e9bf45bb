"""Schemas and names. No column of a quad is ever null; the default graph is the empty string."""

from __future__ import annotations

from pyspark.sql import types as T

#: A quad's columns, and the names that requests use for them.
QUAD = ("s", "p", "o", "g")
NAMES = ("subject", "predicate", "object", "graph")
COLUMN = dict(zip(NAMES, QUAD))

QUADS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in QUAD])
QUOTED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("k", "s", "p", "o")])


def column_of(name: str) -> str:
    """The column of a request's name, such as `subject`; a column's own name stands for itself."""
    if name in COLUMN:
        return COLUMN[name]
    if name in QUAD:
        return name
    raise ValueError(f"no quad component is called {name!r}")


def columns_of(names) -> list[str]:
    """The columns of a request, each once."""
    columns = [column_of(n) for n in names]
    if len(set(columns)) != len(columns):
        raise ValueError("a quad component is asked for twice")
    return columns
