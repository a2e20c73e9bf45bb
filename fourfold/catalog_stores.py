"""Registered queries of stores as users meet them: ways in, changes, versions, streams, layouts, batches and eager reads."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.catalog import GEO, LAYOUTS, MATCHES, PARTS_SQL, PURCHASE, QUADS_SQL, QUOTED_SQL, WITH, Query, ex, parts_of, pred, stored
from fourfold.folders import scratch_path
from fourfold.functions.terms import Literal, Quoted, Var
from fourfold.plans.layouts import reordered, valid
from fourfold.schema import NAMES, QUAD, QUADS_SCHEMA
from fourfold.sources.files import layout_name
from fourfold.sources.tables import quads_of
from fourfold.store import Dataset, QuadStore, StoreOptions
from fourfold.streaming.streams import change_stream, import_stream, remove_stream

#: Quads about quoted triples, in every position, in SQL that Spark and DuckDB both read; and what they quote anew.
NOTES_SQL = """
select concat('<<<ex:user/',user_id,'> <ex:p/did> <<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>>>') s,'<ex:p/level>' p,concat('"',event_type,'"') o,'<ex:g/notes>' g from events where event_type='error'
union select concat('<<<ex:user/',user_id,'> <ex:p/knows> <ex:user/',user_id % 7,'>>>'),'<ex:p/implies>',concat('<<<ex:user/',user_id % 7,'> <ex:p/knows> <ex:user/',user_id,'>>>'),'<ex:g/notes>' from events
union select '<ex:audit>',concat('<<<ex:user/',user_id,'> <ex:p/knows> <ex:user/',user_id % 7,'>>>'),'<ex:user/0>','<ex:g/notes>' from events
union select '<ex:audit>','<ex:p/in>','<ex:user/0>',concat('<<<ex:user/',user_id,'> <ex:p/knows> <ex:user/',user_id % 7,'>>>') from events
"""
BACK_SQL = """select distinct concat('<<<ex:user/',user_id % 7,'> <ex:p/knows> <ex:user/',user_id,'>>>') k,concat('<ex:user/',user_id % 7,'>') s,'<ex:p/knows>' p,concat('<ex:user/',user_id,'>') o from events"""
ALL = f"WITH quads AS (select s,p,o,g from ({QUADS_SQL}) a union select s,p,o,g from ({NOTES_SQL}) b), quoted AS (select k,s,p,o from ({QUOTED_SQL}) a union select k,s,p,o from ({BACK_SQL}) b) "
DID = Quoted(Var("u"), pred("did"), Quoted(Var("e"), pred("type"), Var("t")))
KNOWS, KNOWN = Quoted(Var("a"), pred("knows"), Var("b")), Quoted(Var("b"), pred("knows"), Var("a"))
QUAD_7 = (ex("nation/7"), pred("inRegion"), ex("region/2"), GEO)
NEW = (ex("nation/7"), pred("near"), ex("nation/8"), GEO)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES_SQL.replace("events", "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def annotated(spark: SparkSession, sf_dir: str, **options) -> QuadStore:
    """The tables' store with the notes added."""
    store = stored(spark, sf_dir, **options)
    store.add(notes(spark, sf_dir))
    return store


def of(read) -> Query:
    """A query that reads the annotated store."""
    return lambda spark, sf_dir: read(annotated(spark, sf_dir))


def listed(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def from_constructor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuadStore(spark, quads_of(spark, sf_dir)).match(None, pred("did"), PURCHASE)


def from_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore.create_default(spark)
    store.add(parts_of(spark, sf_dir))
    return store.quads


def refused_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for case, layouts in (("none", []), ("short", [["subject", "predicate"]]), ("twice", [NAMES, ["graph", "graph", "predicate", "object"]])):
        try:
            StoreOptions(layouts=layouts) and QuadStore(spark, options=StoreOptions(layouts=layouts))
        except ValueError as e:
            rows.append((case, str(e)))
    return spark.createDataFrame(rows, "case string, message string")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of four names: is it a layout?"""
    return spark.createDataFrame([(",".join(x), valid(x)) for x in product(NAMES, repeat=4)], "layout string, valid boolean")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quad's components in every layout's order."""
    rows = [(",".join(x), ",".join(reordered(x, QUAD))) for x in product(NAMES, repeat=4) if valid(x)]
    return spark.createDataFrame(rows, "layout string, ordered string")


def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, nodes, v) for nodes in (False, True) for k, v in QuadStore.create_default(spark, nodes).features.items()]
    return spark.createDataFrame(rows, "feature string, with_nodes boolean, value boolean")


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = stored(spark, sf_dir), []
    for name, call in (("nodes", store.nodes), ("get_nodes", store.get_nodes), ("iter_nodes", store.iter_nodes), ("count_nodes", store.count_nodes)):
        try:
            call()
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "call string, message string")


def one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding and removing one quad answers, each twice, and the size after each."""
    store, rows = stored(spark, sf_dir), []
    for step, call in enumerate((store.add_quad, store.add_quad, store.remove_quad, store.remove_quad)):
        rows.append((step, call(*NEW), store.size))
    return spark.createDataFrame(rows, "step int, changed boolean, size long")


def streamed(spark: SparkSession, sf_dir: str, rows) -> DataFrame:
    """Rows that `rows` makes of the events, as a stream; the table may be a file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(spark.read.parquet(path.toString()).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return rows(reader.parquet(path.toString()))
    return rows(reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def did(events: DataFrame) -> DataFrame:
    return events.selectExpr("concat('<ex:user/',user_id,'>') s", "'<ex:p/did>' p", "concat('<<<ex:event/',event_id,'> <ex:p/type> \"',event_type,'\">>') o", "'' g", "event_id seq", "if(event_id % 2 = 0, 'add', 'remove') op")


def by_stream(run, start, read) -> Query:
    """A query that streams what users did into or out of a store, twice, as a batch may come again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = start(spark, sf_dir)
        for _ in range(2):
            run(store, streamed(spark, sf_dir, did), scratch_path(spark, "stream")).awaitTermination()
        return read(store)

    return query


def empty(spark: SparkSession, sf_dir: str) -> QuadStore:
    return QuadStore.create_default(spark)


def committed(spark: SparkSession, sf_dir: str) -> QuadStore:
    """Notes in, a graph out, what users did out; then a version is written and read."""
    store = annotated(spark, sf_dir, folder=scratch_path(spark, "versions"))
    store.delete_graph("ex:g/geo")
    store.remove_matches(p=pred("did"), o=PURCHASE)
    return store.commit()


def changed_by_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when quoted patterns in two positions are removed from a store that was changed before."""
    return annotated(spark, sf_dir).remove_matches(KNOWS, None, KNOWN)


def left_by_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = annotated(spark, sf_dir)
    store.remove_matches(KNOWS, None, KNOWN)
    return store.quads


def dataset_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = stored(spark, sf_dir).as_dataset()
    return data.add(*NEW).delete(*QUAD_7).store.quads


def dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a dataset, of a part of it, and of both after a change of the part, which is its own."""
    data = stored(spark, sf_dir).as_dataset()
    part = data.match(None, None, None, GEO)
    rows = [("whole", data.size), ("part", len(part)), ("part after", part.add(*NEW).size), ("whole after", data.size)]
    return spark.createDataFrame(rows, "which string, n long")


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, iter(Dataset(stored(spark, sf_dir)).match(None, None, None, GEO)), QUADS_SCHEMA)


def eager(call, schema, **options) -> Query:
    return lambda spark, sf_dir: listed(spark, call(stored(spark, sf_dir, **options)), schema)


def own_quoted(inner: bool) -> Query:
    """The quoted triples that a store of the notes alone knows."""
    return lambda spark, sf_dir: QuadStore(spark, notes(spark, sf_dir), options=StoreOptions(inner_quoted=inner)).quoted


def layout_query(layout, *terms) -> Query:
    """A lookup in a store that has one layout."""
    return lambda spark, sf_dir: stored(spark, sf_dir, layouts=[layout]).match(*terms)


def layout_count(layout, *terms) -> Query:
    return lambda spark, sf_dir: spark.createDataFrame([(stored(spark, sf_dir, layouts=[layout]).count(*terms),)], "n long")


def mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of several shapes in one table: nations as subject, as object of inNation, and whole graphs."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.concat(F.lit("<ex:nation/"), F.col("n_nationkey").cast("string"), F.lit(">"))
    null = F.lit(None).cast("string")
    rows = [(F.lit("subject"), name, null, null, null), (F.lit("object"), null, F.lit("<ex:p/inNation>"), name, null), (F.lit("graph"), name, null, null, F.lit("<ex:g/geo>"))]
    each = F.explode(F.array(*(F.struct(*(c.alias(n) for c, n in zip(r, ("shape", *QUAD)))) for r in rows)))
    return stored(spark, sf_dir).match_many(nations.select("n_nationkey", each.alias("x")).select("n_nationkey", "x.*"))


def counted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("<ex:customer/"), F.col("c_custkey").cast("string"), F.lit(">")).alias("o"), F.lit("<ex:p/byCustomer>").alias("p"))
    return stored(spark, sf_dir).count_many(asked)


def quoted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of quoted patterns: of each user what others say of them, `?s ?p <<user ?q ?o>>`."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("<ex:user/"), F.col("user_id").cast("string"), F.lit(">")).alias("o_s")).distinct()
    return annotated(spark, sf_dir).match_many(asked.select(F.col("o_s").alias("about"), "o_s"))


def queries() -> dict[str, Query]:
    quads, pairs, one = QUADS_SCHEMA, "s string, o string", "g string"
    named = {layout_name(x): x for x in LAYOUTS}
    out = {f"layout_{k}_match": layout_query(x, None, pred("inNation"), ex("nation/3")) for k, x in named.items()}
    out |= {f"layout_{k}_quoted": layout_query(x, None, pred("did"), PURCHASE) for k, x in named.items()}
    out |= {f"layout_{k}_count": layout_count(x, ex("order/7"), pred("hasPart")) for k, x in named.items()}
    return out | {
        "constructor_quoted_match": from_constructor,
        "default_store_add": from_default,
        "add_quoted_match": of(lambda x: x.match(None, pred("implies"), KNOWS)),
        "subject_quoted_match": of(lambda x: x.match(DID)),
        "subject_quoted_bindings": of(lambda x: x.bindings(DID, pred("level"), Var("t"), Var("g"))),
        "both_quoted_match": of(lambda x: x.match(KNOWS, None, KNOWN)),
        "both_quoted_bindings": of(lambda x: x.bindings(KNOWS, Var("p"), KNOWN, Var("g"))),
        "predicate_quoted_bindings": of(lambda x: x.bindings(Var("s"), KNOWS, Var("o"), Var("g"))),
        "graph_quoted_match": of(lambda x: x.match(None, None, None, KNOWS)),
        "graph_quoted_count": lambda spark, sf_dir: spark.createDataFrame([(annotated(spark, sf_dir).count(None, None, None, KNOWS),)], "n long"),
        "remove_matches_two_quoted": left_by_quoted,
        "removed_matches_two_quoted": changed_by_quoted,
        "quoted_inner": own_quoted(True),
        "quoted_outer_only": own_quoted(False),
        "quoted_find_by_s": of(lambda x: x.find_quoted(Quoted(ex("user/1"), None, None))),
        "quoted_find_by_o": of(lambda x: x.find_quoted(Quoted(None, None, Literal("error")))),
        "quoted_find_by_sp": of(lambda x: x.find_quoted(Quoted(ex("user/1"), pred("knows"), None))),
        "quoted_find_by_key": of(lambda x: x.find_quoted(Quoted(ex("user/1"), pred("knows"), ex("user/1")))),
        "layout_errors": refused_layouts,
        "layout_valid": sequences,
        "layout_order": orders,
        "features": feature_flags,
        "nodes_guard": guarded,
        "add_remove_quad": one_by_one,
        "commit_quads": lambda spark, sf_dir: committed(spark, sf_dir).quads,
        "commit_quoted_match": lambda spark, sf_dir: committed(spark, sf_dir).match(DID),
        "stream_import": by_stream(import_stream, empty, lambda x: x.quads),
        "stream_quoted_match": by_stream(import_stream, empty, lambda x: x.match(None, pred("did"), PURCHASE)),
        "stream_quoted_find": by_stream(import_stream, empty, lambda x: x.quoted),
        "stream_remove": by_stream(remove_stream, stored, lambda x: x.quads),
        "stream_change": by_stream(change_stream, stored, lambda x: x.quads),
        "dataset_add_delete": dataset_changed,
        "dataset_size": dataset_sizes,
        "dataset_iterate": dataset_rows,
        "get_quads": eager(lambda x: x.get_quads(None, None, None, GEO), quads),
        "iter_quads": eager(lambda x: x.iter_quads(None, None, None, GEO), quads),
        "get_bindings": eager(lambda x: x.get_bindings(Var("s"), pred("related"), Var("o"), GEO), pairs),
        "iter_bindings": eager(lambda x: x.iter_bindings(Var("s"), pred("related"), Var("o"), GEO), pairs),
        "get_distinct_terms": eager(lambda x: x.get_distinct_terms(["graph"]), one),
        "iter_distinct_terms": eager(lambda x: x.iter_distinct_terms(["graph"]), one),
        "get_nodes": eager(lambda x: x.get_nodes(GEO), "g string, node string", index_nodes=True),
        "iter_nodes": eager(lambda x: x.iter_nodes(GEO), "g string, node string", index_nodes=True),
        "match_many_mixed": mixed_batch,
        "match_many_quoted": quoted_batch,
        "count_many": counted_batch,
    }


def oracle_sql() -> dict[str, str]:
    cols = "s, p, o, g"
    geo = f"{WITH} SELECT {cols} FROM quads WHERE g = '<ex:g/geo>'"
    did_sql = """SELECT DISTINCT concat('<ex:user/',user_id,'>') AS s, '<ex:p/did>' AS p, concat('<<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>') AS o, '' AS g FROM events"""
    knows = "SELECT k FROM quoted WHERE p = '<ex:p/knows>'"
    purchase = """SELECT k FROM quoted WHERE p = '<ex:p/type>' AND o = '"purchase"'"""
    deep = "SELECT a.k FROM quoted a JOIN quoted b ON a.o = b.k WHERE a.p = '<ex:p/did>' AND b.p = '<ex:p/type>'"
    two = f"s IN ({knows}) AND o IN ({knows})"
    new = ", ".join(f"'{t.key()}'" for t in NEW)
    names = " UNION ALL ".join(f"SELECT '{n}' AS n, '{c}' AS c" for n, c in zip(NAMES, QUAD))
    four = f"WITH x AS ({names}) SELECT concat_ws(',', a.n, b.n, c.n, d.n) AS layout"
    apart = "a.n <> b.n AND a.n <> c.n AND a.n <> d.n AND b.n <> c.n AND b.n <> d.n AND c.n <> d.n"
    nodes = f"{WITH} SELECT g, s AS node FROM quads WHERE g = '<ex:g/geo>' UNION SELECT g, o FROM quads WHERE g = '<ex:g/geo>'"
    related = f"{WITH} SELECT s, o FROM quads WHERE p = '<ex:p/related>' AND g = '<ex:g/geo>'"
    graphs = f"{WITH} SELECT DISTINCT g FROM quads"
    kept = f"g <> '<ex:g/geo>' AND NOT (p = '<ex:p/did>' AND o IN ({purchase}))"
    out = {}
    for x in LAYOUTS:
        k = layout_name(x)
        out |= {
            f"layout_{k}_match": f"{WITH} SELECT {cols} FROM quads WHERE p = '<ex:p/inNation>' AND o = '<ex:nation/3>'",
            f"layout_{k}_quoted": f"{WITH} SELECT {cols} FROM quads WHERE {MATCHES['quoted_match'][1]}",
            f"layout_{k}_count": f"{WITH} SELECT count(*) AS n FROM quads WHERE s = '<ex:order/7>' AND p = '<ex:p/hasPart>'",
        }
    return out | {
        "constructor_quoted_match": f"{WITH} SELECT {cols} FROM quads WHERE {MATCHES['quoted_match'][1]}",
        "default_store_add": f"SELECT DISTINCT {cols} FROM ({PARTS_SQL})",
        "add_quoted_match": f"{ALL} SELECT {cols} FROM quads WHERE p = '<ex:p/implies>' AND o IN ({knows})",
        "subject_quoted_match": f"{ALL} SELECT {cols} FROM quads WHERE s IN ({deep})",
        "subject_quoted_bindings": f"{ALL} SELECT a.s AS u, b.s AS e, b.o AS t, t.g AS g FROM quads t JOIN quoted a ON t.s = a.k JOIN quoted b ON a.o = b.k WHERE t.p = '<ex:p/level>' AND a.p = '<ex:p/did>' AND b.p = '<ex:p/type>' AND t.o = b.o",
        "both_quoted_match": f"{ALL} SELECT {cols} FROM quads WHERE {two}",
        "both_quoted_bindings": f"{ALL} SELECT a.s AS a, a.o AS b, t.p AS p, t.g AS g FROM quads t JOIN quoted a ON t.s = a.k JOIN quoted b ON t.o = b.k WHERE a.p = '<ex:p/knows>' AND b.p = '<ex:p/knows>' AND a.s = b.o AND a.o = b.s",
        "predicate_quoted_bindings": f"{ALL} SELECT t.s AS s, a.s AS a, a.o AS b, t.o AS o, t.g AS g FROM quads t JOIN quoted a ON t.p = a.k WHERE a.p = '<ex:p/knows>'",
        "graph_quoted_match": f"{ALL} SELECT {cols} FROM quads WHERE g IN ({knows})",
        "graph_quoted_count": f"{ALL} SELECT count(*) AS n FROM quads WHERE g IN ({knows})",
        "remove_matches_two_quoted": f"{ALL} SELECT {cols} FROM quads WHERE NOT ({two})",
        "removed_matches_two_quoted": f"{ALL} SELECT {cols} FROM quads WHERE {two}",
        "quoted_inner": f"{ALL}, n AS ({NOTES_SQL}), top AS (SELECT q.k, q.s, q.p, q.o FROM quoted q WHERE k IN (SELECT s FROM n UNION SELECT p FROM n UNION SELECT o FROM n UNION SELECT g FROM n)) SELECT k, s, p, o FROM top UNION SELECT q.k, q.s, q.p, q.o FROM quoted q JOIN top ON q.k = top.o",
        "quoted_outer_only": f"{ALL}, n AS ({NOTES_SQL}) SELECT k, s, p, o FROM quoted WHERE k IN (SELECT s FROM n UNION SELECT p FROM n UNION SELECT o FROM n UNION SELECT g FROM n)",
        "quoted_find_by_s": f"{ALL} SELECT k, s, p, o FROM quoted WHERE s = '<ex:user/1>'",
        "quoted_find_by_o": f"""{ALL} SELECT k, s, p, o FROM quoted WHERE o = '"error"'""",
        "quoted_find_by_sp": f"{ALL} SELECT k, s, p, o FROM quoted WHERE s = '<ex:user/1>' AND p = '<ex:p/knows>'",
        "quoted_find_by_key": f"{ALL} SELECT k, s, p, o FROM quoted WHERE k = '<<<ex:user/1> <ex:p/knows> <ex:user/1>>>'",
        "layout_errors": "SELECT * FROM (VALUES ('none', 'At least one index combination is required'), ('short', 'Invalid index combination: subject,predicate'), ('twice', 'Invalid index combination: graph,graph,predicate,object')) AS t(\"case\", message)",
        "layout_valid": f"{four}, {apart} AS valid FROM x a, x b, x c, x d",
        "layout_order": f"{four}, concat_ws(',', a.c, b.c, c.c, d.c) AS ordered FROM x a, x b, x c, x d WHERE {apart}",
        "features": "SELECT f.feature, n.w AS with_nodes, CASE WHEN f.feature = 'indexNodes' THEN n.w ELSE true END AS value FROM (VALUES ('quotedTripleFiltering'), ('indexNodes'), ('indexDistinctTerms')) AS f(feature), (VALUES (false), (true)) AS n(w)",
        "nodes_guard": "SELECT call, 'Nodes can only be read when the store was constructed with ''indexNodes: true''' AS message FROM (VALUES ('nodes'), ('get_nodes'), ('iter_nodes'), ('count_nodes')) AS t(call)",
        "add_remove_quad": f"{WITH}, c AS (SELECT count(*) AS n FROM quads) SELECT CAST(step AS INTEGER) AS step, step % 2 = 0 AS changed, n + CASE WHEN step < 2 THEN 1 ELSE 0 END AS size FROM c, (VALUES (0), (1), (2), (3)) AS t(step)",
        "commit_quads": f"{ALL} SELECT {cols} FROM quads WHERE {kept}",
        "commit_quoted_match": f"{ALL} SELECT {cols} FROM quads WHERE s IN ({deep})",
        "stream_import": did_sql,
        "stream_quoted_match": f"WITH d AS ({did_sql}) SELECT {cols} FROM d WHERE o LIKE '%\"purchase\">>'",
        "stream_quoted_find": f"{WITH} SELECT k, s, p, o FROM quoted WHERE p = '<ex:p/type>'",
        "stream_remove": f"{WITH} SELECT {cols} FROM quads EXCEPT {did_sql}",
        "stream_change": f"{WITH} SELECT {cols} FROM quads EXCEPT {did_sql} WHERE event_id % 2 = 1",
        "dataset_add_delete": f"{WITH} SELECT {cols} FROM quads WHERE NOT ({MATCHES['match_spog'][1]}) UNION ALL SELECT {new}",
        "dataset_size": f"{WITH}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE g = '<ex:g/geo>') AS b FROM quads) SELECT which, CASE which WHEN 'whole' THEN a WHEN 'whole after' THEN a WHEN 'part' THEN b ELSE b + 1 END AS n FROM n, (VALUES ('whole'), ('part'), ('part after'), ('whole after')) AS t(which)",
        "dataset_iterate": geo,
        "get_quads": geo,
        "iter_quads": geo,
        "get_bindings": related,
        "iter_bindings": related,
        "get_distinct_terms": graphs,
        "iter_distinct_terms": graphs,
        "get_nodes": nodes,
        "iter_nodes": nodes,
        "match_many_mixed": f"{WITH}, n AS (SELECT n_nationkey, concat('<ex:nation/', n_nationkey, '>') AS x FROM nation) SELECT n_nationkey, 'subject' AS shape, {cols} FROM n JOIN quads ON s = x UNION ALL SELECT n_nationkey, 'object', {cols} FROM n JOIN quads ON o = x AND p = '<ex:p/inNation>' UNION ALL SELECT n_nationkey, 'graph', {cols} FROM n JOIN quads ON s = x AND g = '<ex:g/geo>'",
        "match_many_quoted": f"{ALL}, u AS (SELECT DISTINCT concat('<ex:user/', user_id, '>') AS about FROM events) SELECT u.about AS about, t.s AS s, t.p AS p, t.o AS o, t.g AS g FROM u JOIN quoted q ON q.s = u.about JOIN quads t ON t.o = q.k",
        "count_many": f"{WITH} SELECT concat('<ex:customer/', c_custkey, '>') AS o, '<ex:p/byCustomer>' AS p, (SELECT count(*) FROM quads WHERE p = '<ex:p/byCustomer>' AND quads.o = concat('<ex:customer/', c_custkey, '>')) AS n FROM customer",
    }
