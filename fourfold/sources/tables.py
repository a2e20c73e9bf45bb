"""Relational tables as quads and quoted triples."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.functions.terms import DefaultGraph, iri_key, levels, literal_key, quoted_key
from fourfold.schema import QUADS_SCHEMA

PREFIX = "ex:"


def iri(kind: str, number: Column) -> Column:
    return iri_key(F.concat(F.lit(f"{PREFIX}{kind}/"), number.cast("string")))


def predicate(name: str) -> Column:
    return F.lit(f"<{PREFIX}p/{name}>")


def graph(name: str) -> Column:
    return F.lit(f"<{PREFIX}g/{name}>" if name else "")


def typed_event() -> Column:
    return quoted_key(iri("event", F.col("event_id")), predicate("type"), literal_key(F.col("event_type")))


def claims() -> list[tuple[Column, Column, Column]]:
    """What users claim: that one of two did something, and that they know someone."""
    other = F.col("user_id") + F.col("event_id") % 2
    return [
        (iri("user", other), predicate("did"), literal_key(F.col("event_type"))),
        (iri("user", F.col("user_id")), predicate("knows"), iri("user", F.col("user_id") % 7)),
    ]


def quads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quads of the driver's tables: one scan a table, several quads a row."""
    c = F.col
    date = F.concat(F.lit('"'), c("o_orderdate").cast("date").cast("string"), F.lit('"^^<xsd:date>'))
    source = F.concat(literal_key(c("source")), F.lit("@"), c("lang"))
    user = iri("user", c("user_id"))
    watched = quoted_key(user, predicate("did"), typed_event())
    observed = (F.lit(f"<{PREFIX}audit>"), predicate("observed"), F.when(c("event_type") == "error", watched), graph(""))
    of_nation = iri("nation", c("n_nationkey"))
    plan = {
        "region": [(iri("region", c("r_regionkey")), predicate("name"), literal_key(c("r_name")), graph("geo"))],
        "nation": [
            (of_nation, predicate("name"), literal_key(c("n_name")), graph("geo")),
            (of_nation, predicate("inRegion"), iri("region", c("n_regionkey")), graph("geo")),
            (of_nation, predicate("related"), iri("nation", c("n_nationkey") % 5), graph("geo")),
        ],
        "customer": [
            (iri("customer", c("c_custkey")), predicate("inNation"), iri("nation", c("c_nationkey")), graph("cust")),
            (iri("customer", c("c_custkey")), predicate("segment"), literal_key(c("c_mktsegment")), graph("cust")),
        ],
        "supplier": [(iri("supplier", c("s_suppkey")), predicate("inNation"), iri("nation", c("s_nationkey")), graph("supp"))],
        "orders": [
            (iri("order", c("o_orderkey")), predicate("byCustomer"), iri("customer", c("o_custkey")), graph("orders")),
            (iri("order", c("o_orderkey")), predicate("status"), literal_key(c("o_orderstatus")), graph("orders")),
            (iri("order", c("o_orderkey")), predicate("date"), date, graph("orders")),
        ],
        "lineitem": [(iri("order", c("l_orderkey")), predicate("hasPart"), iri("part", c("l_partkey")), graph("orders"))],
        "part": [(iri("part", c("p_partkey")), predicate("brand"), literal_key(c("p_brand")), graph(""))],
        "events": [(user, predicate("did"), typed_event(), graph("")), observed, *((user, predicate("claims"), quoted_key(*t), graph("claims")) for t in claims())],
        "documents": [(iri("doc", c("doc_id")), predicate("source"), source, graph("docs"))],
    }
    tables = (rows_of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), quads, ("s", "p", "o", "g")) for name, quads in plan.items())
    return reduce(DataFrame.unionByName, tables).distinct()


def quoted_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every quoted triple of the quads, and for those inside them."""
    c = F.col
    event = (iri("event", c("event_id")), predicate("type"), literal_key(c("event_type")))
    watched = (iri("user", c("user_id")), predicate("did"), quoted_key(*event))
    rows = [(quoted_key(*t), *t) for t in (event, *claims())]
    rows.append((F.when(c("event_type") == "error", quoted_key(*watched)), *watched))
    return rows_of(spark.read.parquet(f"{sf_dir}/events.parquet"), rows, ("k", "s", "p", "o")).distinct()


def rows_of(frame: DataFrame, rows: list[tuple[Column, ...]], names: tuple[str, ...]) -> DataFrame:
    """Several rows from each of the table's, without those that have a null."""
    structs = [F.struct(*(x.alias(n) for x, n in zip(row, names))) for row in rows]
    out = frame.select(F.explode(F.array(*structs)).alias("row")).select("row.*")
    return out.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names)))


def quoted_in(quads: DataFrame, inner: bool = True) -> DataFrame:
    """(k, s, p, o) of the quoted triples in rows of keys (s, p, o, g), each once; those inside others too if `inner`.

    The keys are parsed where they are read, by column expressions; a key that is no quoted triple's raises.
    """
    keys = quads.select(F.explode(F.array("s", "p", "o", "g")).alias("key")).where(F.startswith("key", F.lit("<<")))
    found = levels(F.col("key"))
    rows = keys.select(F.explode(found if inner else F.slice(found, -1, 1)).alias("row")).select("row.*")
    return rows.distinct()


def quads_from_terms(spark: SparkSession, quads) -> DataFrame:
    """Rows of tuples of terms (subject, predicate, object, graph); the graph may be left out."""
    rows = [tuple(t.key() for t in ((*quad, DefaultGraph()) if len(quad) == 3 else quad)) for quad in quads]
    columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
    return spark.createDataFrame(pa.table(columns, names=list(QUADS_SCHEMA.names)))  # a local relation: no task of its own
