"""Registered queries of the quad store over the driver's tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.folders import checkpointed, scratch_path
from fourfold.functions.terms import DefaultGraph, Iri, Literal, Quoted, Term, Var
from fourfold.operators import dictionary, matching, mutation
from fourfold.plans.layouts import DEFAULT_LAYOUTS, best, best_for_pattern, path, score
from fourfold.plans.pattern import Pattern
from fourfold.schema import NAMES, QUAD
from fourfold.sources.tables import quads_of, quoted_of
from fourfold.store import QuadStore, StoreOptions

Query = Callable[[SparkSession, str], DataFrame]

#: The tables as quads and as quoted triples, in SQL that Spark and DuckDB both read.
QUADS_SQL = """
select distinct s,p,o,g from (
 select concat('<ex:region/',r_regionkey,'>') s,'<ex:p/name>' p,concat('"',r_name,'"') o,'<ex:g/geo>' g from region
 union all select concat('<ex:nation/',n_nationkey,'>'),'<ex:p/name>',concat('"',n_name,'"'),'<ex:g/geo>' from nation
 union all select concat('<ex:nation/',n_nationkey,'>'),'<ex:p/inRegion>',concat('<ex:region/',n_regionkey,'>'),'<ex:g/geo>' from nation
 union all select concat('<ex:nation/',n_nationkey,'>'),'<ex:p/related>',concat('<ex:nation/',n_nationkey % 5,'>'),'<ex:g/geo>' from nation
 union all select concat('<ex:customer/',c_custkey,'>'),'<ex:p/inNation>',concat('<ex:nation/',c_nationkey,'>'),'<ex:g/cust>' from customer
 union all select concat('<ex:customer/',c_custkey,'>'),'<ex:p/segment>',concat('"',c_mktsegment,'"'),'<ex:g/cust>' from customer
 union all select concat('<ex:supplier/',s_suppkey,'>'),'<ex:p/inNation>',concat('<ex:nation/',s_nationkey,'>'),'<ex:g/supp>' from supplier
 union all select concat('<ex:order/',o_orderkey,'>'),'<ex:p/byCustomer>',concat('<ex:customer/',o_custkey,'>'),'<ex:g/orders>' from orders
 union all select concat('<ex:order/',o_orderkey,'>'),'<ex:p/status>',concat('"',o_orderstatus,'"'),'<ex:g/orders>' from orders
 union all select concat('<ex:order/',l_orderkey,'>'),'<ex:p/hasPart>',concat('<ex:part/',l_partkey,'>'),'<ex:g/orders>' from lineitem
 union all select concat('<ex:part/',p_partkey,'>'),'<ex:p/brand>',concat('"',p_brand,'"'),'' from part
 union all select concat('<ex:user/',user_id,'>'),'<ex:p/did>',concat('<<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>'),'' from events
 union all select '<ex:audit>','<ex:p/observed>',concat('<<<ex:user/',user_id,'> <ex:p/did> <<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>>>'),'' from events where event_type='error'
 union all select concat('<ex:order/',o_orderkey,'>'),'<ex:p/date>',concat('"',cast(o_orderdate as date),'"^^<xsd:date>'),'<ex:g/orders>' from orders
 union all select concat('<ex:doc/',doc_id,'>'),'<ex:p/source>',concat('"',source,'"@',lang),'<ex:g/docs>' from documents
 union all select concat('<ex:user/',user_id,'>'),'<ex:p/claims>',concat('<<<ex:user/',user_id + event_id % 2,'> <ex:p/did> "',event_type,'">>'),'<ex:g/claims>' from events
 union all select concat('<ex:user/',user_id,'>'),'<ex:p/claims>',concat('<<<ex:user/',user_id,'> <ex:p/knows> <ex:user/',user_id % 7,'>>>'),'<ex:g/claims>' from events
) t
"""
QUOTED_SQL = """
select distinct k,s,p,o from (
 select concat('<<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>') k,concat('<ex:event/',event_id,'>') s,'<ex:p/type>' p,concat('"',event_type,'"') o from events
 union all select concat('<<<ex:user/',user_id,'> <ex:p/did> <<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>>>'),concat('<ex:user/',user_id,'>'),'<ex:p/did>',concat('<<<ex:event/',event_id,'> <ex:p/type> "',event_type,'">>') from events where event_type='error'
 union all select concat('<<<ex:user/',user_id + event_id % 2,'> <ex:p/did> "',event_type,'">>'),concat('<ex:user/',user_id + event_id % 2,'>'),'<ex:p/did>',concat('"',event_type,'"') from events
 union all select concat('<<<ex:user/',user_id,'> <ex:p/knows> <ex:user/',user_id % 7,'>>>'),concat('<ex:user/',user_id,'>'),'<ex:p/knows>',concat('<ex:user/',user_id % 7,'>') from events) t
"""
WITH = f"WITH quads AS ({QUADS_SQL}), quoted AS ({QUOTED_SQL}) "


def ex(name: str) -> Iri:
    return Iri(f"ex:{name}")


def pred(name: str) -> Iri:
    return ex(f"p/{name}")


PURCHASE = Quoted(Var("e"), pred("type"), Literal("purchase"))
WATCHED = Quoted(ex("user/1"), Var("p"), Quoted(Var("e"), pred("type"), Var("t")))
SHARED = Quoted(Var("s"), Var("q"), Var("o"))
KNOWS = Quoted(Var("x"), pred("knows"), Var("x"))

#: Matches: a pattern, and the same condition in SQL.
MATCHES: dict[str, tuple[Pattern, str]] = {
    "quads_all": (Pattern(), "true"),
    "match_p": (Pattern(predicate=pred("inNation")), "p = '<ex:p/inNation>'"),
    "match_sp": (Pattern(ex("order/7"), pred("hasPart")), "s = '<ex:order/7>' and p = '<ex:p/hasPart>'"),
    "match_po": (Pattern(None, pred("inNation"), ex("nation/3")), "p = '<ex:p/inNation>' and o = '<ex:nation/3>'"),
    "match_so": (Pattern(ex("nation/3"), None, ex("nation/3")), "s = '<ex:nation/3>' and o = '<ex:nation/3>'"),
    "match_s": (Pattern(ex("order/7")), "s = '<ex:order/7>'"),
    "match_o": (Pattern(None, None, ex("nation/3")), "o = '<ex:nation/3>'"),
    "match_spog": (Pattern(ex("nation/7"), pred("inRegion"), ex("region/2"), ex("g/geo")), "s = '<ex:nation/7>' and p = '<ex:p/inRegion>' and o = '<ex:region/2>' and g = '<ex:g/geo>'"),
    "match_graph": (Pattern(graph=ex("g/geo")), "g = '<ex:g/geo>'"),
    "match_default_graph": (Pattern(graph=DefaultGraph()), "g = ''"),
    "match_any_graph": (Pattern(None, pred("did"), None, Var("g")), "p = '<ex:p/did>'"),
    "match_unknown_term": (Pattern(ex("nobody")), "s = '<ex:nobody>'"),
    "match_repeated_var_ignored": (Pattern(Var("x"), pred("related"), Var("x")), "p = '<ex:p/related>'"),
    "match_literal": (Pattern(None, pred("segment"), Literal("BUILDING")), """p = '<ex:p/segment>' and o = '"BUILDING"'"""),
    "match_ground_quoted": (
        Pattern(None, None, Quoted(ex("user/1"), pred("knows"), ex("user/1"))),
        "o = '<<<ex:user/1> <ex:p/knows> <ex:user/1>>>'",
    ),
    "quoted_match": (Pattern(None, pred("did"), PURCHASE), """p = '<ex:p/did>' and o in (select k from quoted where p = '<ex:p/type>' and o = '"purchase"')"""),
    "quoted_match_nested": (
        Pattern(None, None, Quoted(Var("u"), pred("did"), Quoted(Var("e"), pred("type"), Literal("error")))),
        """o in (select k from quoted where p = '<ex:p/did>' and o in (select k from quoted where p = '<ex:p/type>' and o = '"error"'))""",
    ),
    "quoted_match_intra_repeat": (Pattern(None, None, KNOWS), "o in (select k from quoted where p = '<ex:p/knows>')"),
    "quoted_match_other_graph": (Pattern(None, None, Quoted(Var("x"), Var("y"), Var("z"), ex("g/geo"))), "false"),
}

#: Bindings: a pattern, and SQL over quads t and quoted a, b.
BINDINGS: dict[str, tuple[Pattern, str]] = {
    "bindings_vars": (Pattern(Var("c"), pred("inNation"), Var("n"), Var("g")), "select s as c, o as n, g from quads where p = '<ex:p/inNation>'"),
    "bindings_all": (Pattern(Var("a"), Var("b"), Var("c"), Var("d")), "select s as a, p as b, o as c, g as d from quads"),
    "bindings_reused_s_o": (Pattern(Var("x"), Var("p"), Var("x"), Var("g")), "select s as x, p, g from quads where s = o"),
    "quoted_bindings": (
        Pattern(Var("u"), pred("did"), Quoted(Var("e"), pred("type"), Var("t")), DefaultGraph()),
        "select t.s as u, a.s as e, a.o as t from quads t join quoted a on t.o = a.k where t.p = '<ex:p/did>' and t.g = '' and a.p = '<ex:p/type>'",
    ),
    "quoted_bindings_whole": (
        Pattern(Var("u"), pred("claims"), Var("claim"), Var("g")),
        "select s as u, o as claim, g from quads where p = '<ex:p/claims>'",
    ),
    "quoted_bindings_nested": (
        Pattern(ex("audit"), pred("observed"), WATCHED, Var("g")),
        "select a.p as p, b.s as e, b.o as t, t.g as g from quads t join quoted a on t.o = a.k join quoted b on a.o = b.k where t.s = '<ex:audit>' and t.p = '<ex:p/observed>' and a.s = '<ex:user/1>' and b.p = '<ex:p/type>'",
    ),
    "quoted_bindings_shared": (
        Pattern(Var("s"), Var("p"), SHARED, Var("g")),
        "select t.s as s, t.p as p, a.p as q, a.o as o, t.g as g from quads t join quoted a on t.o = a.k where t.s = a.s",
    ),
    "quoted_bindings_intra_repeat": (
        Pattern(Var("u"), Var("p"), KNOWS, Var("g")),
        "select t.s as u, t.p as p, a.s as x, t.g as g from quads t join quoted a on t.o = a.k where a.p = '<ex:p/knows>' and a.s = a.o",
    ),
    "quoted_bindings_graph_var": (
        Pattern(Var("u"), pred("did"), Quoted(Var("e"), pred("type"), Var("t"), Var("h")), Var("g")),
        "select t.s as u, a.s as e, a.o as t, '' as h, t.g as g from quads t join quoted a on t.o = a.k where t.p = '<ex:p/did>' and a.p = '<ex:p/type>'",
    ),
}

SUBSETS = ["".join(c) for n in range(1, 5) for c in combinations(QUAD, n)]


#: The layouts that the tables' store is saved in: the default ones and three that don't start with the graph.
LAYOUTS = (*DEFAULT_LAYOUTS, NAMES, ("predicate", "object", "subject", "graph"), ("object", "subject", "predicate", "graph"))
_saved: dict[tuple[str, str], str] = {}


def folder_of(spark: SparkSession, sf_dir: str) -> str:
    """Where the tables' store is saved, in the shared folder; it is built and written once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _saved:
        path = scratch_path(spark, "store")
        QuadStore(spark, quads_of(spark, sf_dir), quoted_of(spark, sf_dir), StoreOptions(layouts=LAYOUTS)).save(path)
        _saved[key] = path
    return _saved[key]


def stored(spark: SparkSession, sf_dir: str, **options) -> QuadStore:
    """The tables' store, read from its folder; each call gives a handle of its own."""
    return QuadStore.load(spark, folder_of(spark, sf_dir), StoreOptions(**options))


def read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = stored(spark, sf_dir)
    return store.quads, store.quoted


def terms_at(pattern: Pattern) -> list[Term | None]:
    return [t for _, t in pattern.positions]


def match_query(pattern: Pattern) -> Query:
    return lambda spark, sf_dir: stored(spark, sf_dir).match(*terms_at(pattern))


def count_query(pattern: Pattern) -> Query:
    return lambda spark, sf_dir: spark.createDataFrame([(stored(spark, sf_dir).count(*terms_at(pattern)),)], "n long")


def bindings_query(pattern: Pattern) -> Query:
    return lambda spark, sf_dir: stored(spark, sf_dir).bindings(*terms_at(pattern))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solutions of a pattern without variables are rows without columns; a column makes them comparable."""
    pattern = Pattern(ex("nation/7"), pred("inRegion"), ex("region/2"), ex("g/geo"))
    return stored(spark, sf_dir).bindings(*terms_at(pattern)).select(F.lit(1).alias("matched"))


def on_quads(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(read(spark, sf_dir)[0])


def distinct_query(names: Sequence[str], count: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        quads = stored(spark, sf_dir).scan([NAMES[QUAD.index(n)] if n in QUAD else n for n in names], whole=True)
        return matching.count_distinct_terms(quads, names) if count else matching.distinct_terms(quads, names)

    return query


def parts_of(spark: SparkSession, sf_dir: str, columns: str = "") -> DataFrame:
    """What `lineitem` says of orders' parts, with natural repeats, as a batch of quads."""
    from fourfold.sources.tables import graph, iri, predicate

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(iri("order", F.col("l_orderkey")).alias("s"), predicate("hasPart").alias("p"), iri("part", F.col("l_partkey")).alias("o"), graph("orders").alias("g"))


def without_parts(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") != "<ex:p/hasPart>")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dense_ids(dictionary.terms_of(*read(spark, sf_dir)))


def shapes() -> list[list[str]]:
    return [[n for k, n in enumerate(NAMES) if bits >> k & 1] for bits in range(16)]


def layout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each of the 16 shapes of a pattern its bound components, the layouts' scores and the choice."""
    rows = [(",".join(b), *(score(x, b) for x in DEFAULT_LAYOUTS), best_for_pattern(DEFAULT_LAYOUTS, b), best(DEFAULT_LAYOUTS, b)) for b in shapes()]
    return spark.createDataFrame(rows, "bound string, gspo int, gpos int, gosp int, for_pattern int, for_terms int")


def scores_sql() -> str:
    """The choice in SQL: sums of the bound components' weights in each layout, the first of the largest."""
    weights = [[4 - layout.index(n) for n in NAMES] for layout in DEFAULT_LAYOUTS]
    bits = "(range >> {} & 1)"
    sums = [" + ".join(f"{w} * {bits.format(k)}" for k, w in enumerate(x)) for x in weights]
    names = ", ".join(f"case when {bits.format(k)} = 1 then '{n}' end" for k, n in enumerate(NAMES))
    return f"""WITH x AS (SELECT concat_ws(',', {names}) AS bound, range, CAST({sums[0]} AS INTEGER) AS gspo, CAST({sums[1]} AS INTEGER) AS gpos,
        CAST({sums[2]} AS INTEGER) AS gosp FROM range(16)), y AS (SELECT *, CASE WHEN gspo >= gpos AND gspo >= gosp THEN 0 WHEN gpos >= gosp THEN 1 ELSE 2 END AS for_terms FROM x)
        SELECT bound, gspo, gpos, gosp, CASE WHEN range = 15 THEN 0 ELSE for_terms END AS for_pattern, for_terms FROM y"""


def layout_query(layout: Sequence[str], taken: Sequence[bool], count: bool = False) -> Query:
    f = matching.count_layout_terms if count else matching.layout_terms
    return on_quads(lambda q: f(q, layout, taken))


def tree(change: Callable[[DataFrame, DataFrame], mutation.Change], changed: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = change(*read(spark, sf_dir))
        return found.changed if changed else found.quads

    return query


def found_quoted(pattern: Quoted) -> Query:
    return lambda spark, sf_dir: stored(spark, sf_dir).find_quoted(pattern)


def add_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.add(without_parts(read(spark, sf_dir)[0]), parts_of(spark, sf_dir)).changed


def add_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.add(read(spark, sf_dir)[0], parts_of(spark, sf_dir)).quads


def remove_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.remove(read(spark, sf_dir)[0], parts_of(spark, sf_dir)).quads


def removed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.remove(read(spark, sf_dir)[0], parts_of(spark, sf_dir)).changed


def dataset_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(spark, sf_dir).as_dataset().has(ex("nation/7"), pred("inRegion"), ex("region/2"), ex("g/geo"))
    return spark.createDataFrame([(found,)], "found boolean")


def dataset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).as_dataset().match(None, None, None, GEO).store.quads


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads as ids, and back."""
    quads, quoted = read(spark, sf_dir)
    ids = checkpointed(dictionary.dense_ids(dictionary.terms_of(quads, quoted)))
    out = dictionary.encoded_quads(ids, quads)
    for c in QUAD:
        out = out.join(ids.select(F.col("id").alias(c), F.col("key").alias(f"{c}_key")), c)
    return out.select(*(F.col(f"{c}_key").alias(c) for c in QUAD))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `decode` gives for the ids of all objects."""
    quads, quoted = read(spark, sf_dir)
    ids = checkpointed(dictionary.dense_ids(dictionary.terms_of(quads, quoted)))
    asked = quads.select(F.col("o").alias("key")).distinct().join(ids, "key").select("id")
    return dictionary.decode(ids, asked).select("key")


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of one graph's terms, filled up with all: known ids stay, new ones follow without gaps."""
    quads, quoted = read(spark, sf_dir)
    first = checkpointed(dictionary.dense_ids(dictionary.terms_of(quads.where("g = '<ex:g/geo>'"), quoted.limit(0))))
    both = dictionary.encode(first, dictionary.terms_of(quads, quoted)).join(first.select("key", F.col("id").alias("was")), "key", "left")
    kept = F.count_if(F.col("id") == F.col("was"))
    return both.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"), kept.alias("kept"))


def all_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.encodings(known(spark, sf_dir)).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def id_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids have no gaps, and plain terms come first."""
    ids = known(spark, sf_dir)
    quoted = F.startswith("key", F.lit("<<"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"), F.min(F.when(quoted, F.col("id"))).alias("first_quoted"))


def optional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the customers' terms, and of as many that are nobody's, the dictionary has."""
    kind = F.explode(F.array(F.lit("customer"), F.lit("nobody")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", kind.alias("kind"))
    asked = rows.select(F.concat(F.lit("<ex:"), "kind", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(">")).alias("key"))
    return dictionary.encode_optional(known(spark, sf_dir), asked).select("key", F.col("id").isNotNull().alias("known"))


def literal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir)[0].where("o like '\"%'").select(F.col("o").alias("key")).distinct()
    return dictionary.term_table(keys).select("key", "kind", "value", F.coalesce("datatype", F.lit("")).alias("datatype"), F.coalesce("language", F.lit("")).alias("language"))


def term_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dictionary.terms_of(*read(spark, sf_dir)).select("key")
    return dictionary.term_table(keys).groupBy("kind").agg(F.count("*").alias("n"))


def node_query(graph: Term | None, count: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stored(spark, sf_dir, index_nodes=True).nodes(graph)
        return found.agg(F.count("*").alias("n")) if count else found

    return query


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many patterns at once: of each customer the quads that it is subject of."""
    store = stored(spark, sf_dir)
    asked = store.match(None, pred("byCustomer")).select(F.col("o").alias("asked"), F.col("o").alias("s")).distinct()
    return store.match_many(asked).select("asked", "p", "o", "g")


NODES_SQL = "SELECT g, s AS node FROM quads {0} UNION SELECT g, o FROM quads {0}"
PARTS_SQL = "SELECT concat('<ex:order/',l_orderkey,'>') AS s, '<ex:p/hasPart>' AS p, concat('<ex:part/',l_partkey,'>') AS o, '<ex:g/orders>' AS g FROM lineitem"
GEO = ex("g/geo")
SPOG = NAMES


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out |= {name: match_query(pattern) for name, (pattern, _) in MATCHES.items()}
    out |= {name: bindings_query(pattern) for name, (pattern, _) in BINDINGS.items()}
    out |= {f"distinct_{x}": distinct_query(list(x)) for x in SUBSETS}
    out |= {f"count_distinct_{x}": distinct_query(list(x), count=True) for x in SUBSETS}
    return out | {
        "size": count_query(Pattern()),
        "count_pattern": count_query(Pattern(predicate=pred("did"))),
        "count_quoted": count_query(MATCHES["quoted_match"][0]),
        "bindings_ground": ground,
        "distinct_gp": distinct_query(["graph", "predicate"]),
        "distinct_empty": distinct_query([], count=True),
        "index_find_terms_prefix": layout_query(SPOG, [True, False, False, False]),
        "index_find_terms_path": layout_query(DEFAULT_LAYOUTS[0], path(DEFAULT_LAYOUTS[0], ["graph", "subject"])),
        "index_count_terms_gap": layout_query(SPOG, [True, False, True], count=True),
        "index_count_terms_full": layout_query(SPOG, [True, False, False, False], count=True),
        "nodes_all": node_query(None),
        "nodes_graph": node_query(GEO),
        "nodes_unknown_graph": node_query(ex("g/none")),
        "count_nodes_all": node_query(Var("g"), count=True),
        "count_nodes_graph": node_query(GEO, count=True),
        "add_new": add_new,
        "add_duplicates_ignored": add_all,
        "remove_batch": remove_batch,
        "removed_batch": removed_batch,
        "remove_matches": tree(lambda q, t: mutation.remove_matches(q, t, Pattern(predicate=pred("did")))),
        "remove_matches_quoted": tree(lambda q, t: mutation.remove_matches(q, t, Pattern(object=PURCHASE))),
        "delete_graph": tree(lambda q, t: mutation.delete_graph(q, "<ex:g/orders>")),
        "delete_default_graph": tree(lambda q, t: mutation.delete_graph(q, "")),
        "dataset_has": dataset_has,
        "dataset_match": dataset_match,
        "quoted_find": found_quoted(Quoted(Var("e"), pred("type"), Var("t"))),
        "quoted_find_nested": found_quoted(Quoted(Var("u"), Var("p"), Quoted(Var("e"), pred("type"), Literal("error")))),
        "quoted_all": lambda spark, sf_dir: stored(spark, sf_dir).quoted,
        "dict_encode_dense": id_statistics,
        "dict_encode_grown": grown,
        "dict_encodings": all_encodings,
        "dict_round_trip": round_trip,
        "dict_encode_optional": optional_ids,
        "dict_decode": decoded,
        "literal_parts": literal_parts,
        "term_kinds": term_kinds,
        "layout_scores": layout_scores,
        "batch_lookup": batch_lookup,
    }


def oracle_sql() -> dict[str, str]:
    cols = "s, p, o, g"
    out = {name: f"{WITH} SELECT {cols} FROM quads WHERE {where}" for name, (_, where) in MATCHES.items()}
    out |= {name: f"{WITH} {sql}" for name, (_, sql) in BINDINGS.items()}
    listed = {x: ", ".join(x) for x in SUBSETS}
    out |= {f"distinct_{x}": f"{WITH} SELECT DISTINCT {c} FROM quads" for x, c in listed.items()}
    out |= {f"count_distinct_{x}": f"{WITH} SELECT count(*) AS n FROM (SELECT DISTINCT {c} FROM quads)" for x, c in listed.items()}
    quads = lambda where, select=cols: f"{WITH} SELECT {select} FROM quads WHERE {where}"
    terms = "SELECT s AS key FROM quads UNION SELECT p FROM quads UNION SELECT o FROM quads UNION SELECT g FROM quads UNION SELECT k FROM quoted UNION SELECT s FROM quoted UNION SELECT p FROM quoted UNION SELECT o FROM quoted"
    purchase = """o IN (SELECT k FROM quoted WHERE p = '<ex:p/type>' AND o = '"purchase"')"""
    return out | {
        "size": quads("true", "count(*) AS n"),
        "count_pattern": quads("p = '<ex:p/did>'", "count(*) AS n"),
        "count_quoted": quads(MATCHES["quoted_match"][1], "count(*) AS n"),
        "bindings_ground": quads(MATCHES["match_spog"][1], "1 AS matched"),
        "distinct_gp": f"{WITH} SELECT DISTINCT g, p FROM quads",
        "distinct_empty": f"{WITH} SELECT count(*) AS n FROM (SELECT DISTINCT 1 FROM quads)",
        "index_find_terms_prefix": quads("true", "s"),
        "index_find_terms_path": f"{WITH} SELECT DISTINCT g, s FROM quads",
        "index_count_terms_gap": f"{WITH} SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM quads)",
        "index_count_terms_full": quads("true", "count(*) AS n"),
        "nodes_all": f"{WITH} {NODES_SQL.format('')}",
        "nodes_graph": f"{WITH} {NODES_SQL.format("WHERE g = '<ex:g/geo>'")}",
        "nodes_unknown_graph": f"{WITH} {NODES_SQL.format('WHERE false')}",
        "count_nodes_all": f"{WITH} SELECT count(*) AS n FROM ({NODES_SQL.format('')})",
        "count_nodes_graph": f"{WITH} SELECT count(*) AS n FROM ({NODES_SQL.format("WHERE g = '<ex:g/geo>'")})",
        "add_new": f"SELECT DISTINCT * FROM ({PARTS_SQL})",
        "add_duplicates_ignored": f"{WITH} SELECT {cols} FROM quads UNION {PARTS_SQL}",
        "remove_batch": f"{WITH} SELECT {cols} FROM quads EXCEPT {PARTS_SQL}",
        "removed_batch": f"{WITH} SELECT {cols} FROM quads INTERSECT {PARTS_SQL}",
        "remove_matches": quads("p <> '<ex:p/did>'"),
        "remove_matches_quoted": quads(f"NOT ({purchase})"),
        "delete_graph": quads("g <> '<ex:g/orders>'"),
        "delete_default_graph": quads("g <> ''"),
        "dataset_has": quads(MATCHES["match_spog"][1], "count(*) > 0 AS found"),
        "dataset_match": quads("g = '<ex:g/geo>'"),
        "quoted_find": f"{WITH} SELECT k, s, p, o FROM quoted WHERE p = '<ex:p/type>'",
        "quoted_find_nested": f"""{WITH} SELECT k, s, p, o FROM quoted WHERE o IN (SELECT k FROM quoted WHERE p = '<ex:p/type>' AND o = '"error"')""",
        "quoted_all": f"{WITH} SELECT k, s, p, o FROM quoted",
        "dict_encode_dense": f"{WITH}, t AS ({terms}) SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) FILTER (WHERE NOT starts_with(key, '<<')) AS first_quoted FROM t",
        "dict_encode_grown": f"{WITH}, t AS ({terms}), geo AS (SELECT s AS key FROM quads WHERE g = '<ex:g/geo>' UNION SELECT p FROM quads WHERE g = '<ex:g/geo>' UNION SELECT o FROM quads WHERE g = '<ex:g/geo>' UNION SELECT '<ex:g/geo>') SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, (SELECT count(*) FROM geo) AS kept FROM t",
        "dict_encodings": f"{WITH}, t AS ({terms}) SELECT count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM t",
        "dict_round_trip": quads("true"),
        "dict_encode_optional": "SELECT concat('<ex:', kind, '/', c_custkey, '>') AS key, kind = 'customer' AND c_custkey IN (SELECT c_custkey FROM customer) AS known FROM customer, (VALUES ('customer'), ('nobody')) AS k(kind)",
        "dict_decode": f"{WITH} SELECT DISTINCT o AS key FROM quads",
        "literal_parts": f"""{WITH} SELECT DISTINCT o AS key, 'literal' AS kind, regexp_extract(o, '^"([^"]*)"', 1) AS value, regexp_extract(o, '"\\^\\^<([^<>]*)>$', 1) AS datatype, regexp_extract(o, '"@([^"@]*)$', 1) AS language FROM quads WHERE o LIKE '"%'""",
        "term_kinds": f"{WITH}, t AS ({terms}) SELECT CASE WHEN key = '' THEN 'default' WHEN starts_with(key, '<<') THEN 'quoted' WHEN starts_with(key, '<') THEN 'iri' WHEN starts_with(key, '_:') THEN 'blank' ELSE 'literal' END AS kind, count(*) AS n FROM t GROUP BY 1",
        "layout_scores": scores_sql(),
        "batch_lookup": f"{WITH} SELECT a.o AS asked, q.p AS p, q.o AS o, q.g AS g FROM (SELECT DISTINCT o FROM quads WHERE p = '<ex:p/byCustomer>') a JOIN quads q ON q.s = a.o",
    }
