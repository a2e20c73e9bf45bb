"""The dictionary layout: dense ids for terms. Queries don't need it, as keys decode themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fourfold.functions.terms import datatype, direction, kind, language, value
from fourfold.schema import QUAD

#: Hash ranges that ids are numbered in, and so the most tasks that number them.
RANGES = 1 << 16


def terms_of(quads: DataFrame, quoted: DataFrame) -> DataFrame:
    """(key, is_quoted) of every term of the quads and inside quoted triples, quoted triples included."""
    plain = quads.select(F.explode(F.array(*QUAD)).alias("key")).union(quoted.select(F.explode(F.array("k", "s", "p", "o")).alias("key")))
    return plain.distinct().withColumn("is_quoted", F.startswith("key", F.lit("<<")))


def dense_ids(terms: DataFrame, first: int = 0) -> DataFrame:
    """(id, key): plain terms first, then quoted ones, numbered without gaps from `first`.

    Ranges of the key's hash are counted, their first ids are sums of a table of 2 x RANGES rows, and each range is numbered
    by key on its own, so no task sees all terms.
    """
    spread = terms.select("key", F.col("is_quoted").cast("int").alias("later"), F.pmod(F.xxhash64("key"), F.lit(RANGES)).alias("range"))
    counts = spread.groupBy("later", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("later", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("later", "range", before.alias("before")))  # 2 x RANGES rows at most
    inside = F.row_number().over(Window.partitionBy("later", "range").orderBy("key"))
    numbered = spread.withColumn("inside", inside).join(starts, ["later", "range"])
    return numbered.select((F.lit(first) + F.col("before") + F.col("inside") - 1).alias("id"), "key")


def encode(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """The dictionary with the new of `terms` (key, is_quoted) added; known terms keep their ids."""
    new = terms.distinct().join(dictionary, "key", "left_anti")
    first = dictionary.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    return dictionary.unionByName(dense_ids(new, first))


def encode_optional(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, id), id null for terms that the dictionary lacks."""
    return terms.select("key").join(dictionary, "key", "left")


def decode(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, key) of `ids`; an id that the dictionary lacks raises when the rows are read."""
    joined = ids.select("id").join(dictionary, "id", "left")
    failed = F.raise_error(F.concat(F.lit("no term has the id "), F.col("id").cast("string")))
    return joined.select("id", F.coalesce("key", failed).alias("key"))


def encodings(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("id")


def encoded_quads(dictionary: DataFrame, quads: DataFrame) -> DataFrame:
    """The quads as ids, one join a column."""
    for c in QUAD:
        ids = dictionary.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
        quads = quads.join(ids, c)
    return quads.select(*(F.col(f"{c}_id").alias(c) for c in QUAD))


def term_table(keys: DataFrame) -> DataFrame:
    """`keys` (key) with the parts of each term: kind, value, datatype, language, direction."""
    key = F.col("key")
    return keys.select("key", kind(key).alias("kind"), value(key).alias("value"), datatype(key).alias("datatype"), language(key).alias("language"), direction(key).alias("direction"))
