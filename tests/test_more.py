"""Dictionary, sources and streams."""

import pytest
from pyspark.sql import functions as F

from fourfold import catalog
from fourfold.functions.terms import Iri
from fourfold.operators import dictionary
from fourfold.schema import QUADS_SCHEMA
from fourfold.sources.files import without_nulls
from fourfold.sources.tables import quads_of, quoted_of
from fourfold.store import QuadStore
from fourfold.streaming.streams import change_stream, import_stream, remove_stream


def test_dense_ids(spark, sf_dir):
    quads, quoted = quads_of(spark, sf_dir).where("g = '<ex:g/geo>'"), quoted_of(spark, sf_dir).limit(50)
    terms = dictionary.terms_of(quads, quoted)
    ids = dictionary.dense_ids(terms)
    rows = {r["key"]: r["id"] for r in ids.collect()}
    assert sorted(rows.values()) == list(range(len(rows)))
    assert max(i for k, i in rows.items() if not k.startswith("<<")) < min(i for k, i in rows.items() if k.startswith("<<"))
    more = spark.createDataFrame([("<new>", False), ("<ex:nation/3>", False)], "key string, is_quoted boolean")
    grown = {r["key"]: r["id"] for r in dictionary.encode(ids, more).collect()}
    assert grown == rows | {"<new>": len(rows)}
    with pytest.raises(Exception, match="no term has the id 999999"):
        dictionary.decode(ids, spark.createDataFrame([(999999,)], "id long")).collect()
    assert dictionary.encodings(ids).count() == len(rows)


def test_anchors(spark, sf_dir):
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("counts of sf0.001")
    count = lambda name: catalog.queries()[name](spark, sf_dir).count()
    assert quads_of(spark, sf_dir).count() == 12598 and quoted_of(spark, sf_dir).count() == 1296
    assert count("quoted_bindings_shared") == 90 and count("quoted_bindings_nested") == 9 and count("nodes_all") == 5020


def test_nulls_are_refused(spark):
    with pytest.raises(Exception, match="a quad has no o"):
        without_nulls(spark.createDataFrame([("a", "b", None, "")], QUADS_SCHEMA)).collect()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("<s1>", "<p>", "<o>", ""), ("<s2>", "<p>", "<o>", ""), ("<s1>", "<p>", "<o>", "")]
    spark.createDataFrame(rows, QUADS_SCHEMA).write.parquet(str(source))
    stream = spark.readStream.schema(QUADS_SCHEMA).parquet(str(source))
    store = QuadStore.create_default(spark)
    import_stream(store, stream, str(tmp_path / "c1")).awaitTermination()
    assert store.size == 2
    import_stream(store, stream, str(tmp_path / "c2")).awaitTermination()
    assert store.size == 2
    remove_stream(store, stream.where(F.col("s") == "<s1>"), str(tmp_path / "c3")).awaitTermination()
    assert [r["s"] for r in store.get_quads()] == ["<s2>"]


def test_mixed_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("<a>", "<p>", "<o>", "", 1, "add"), ("<a>", "<p>", "<o>", "", 2, "remove"), ("<b>", "<p>", "<o>", "", 1, "remove"), ("<b>", "<p>", "<o>", "", 3, "add")]
    schema = "s string, p string, o string, g string, seq int, op string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    store = QuadStore.create_default(spark)
    change_stream(store, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "c")).awaitTermination()
    assert [r["s"] for r in store.get_quads(Iri("a"))] == [] and store.count(Iri("b")) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
