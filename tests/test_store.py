"""Stores of a few quads: changes, reads, quoted triples, nodes, datasets; every layout gives the same answers."""

from collections import Counter
from itertools import permutations

import pytest

from fourfold.functions.terms import Blank, DefaultGraph, Iri, Literal, Quoted, Var
from fourfold.schema import NAMES, QUADS_SCHEMA
from fourfold.sources.files import quoted_layout
from fourfold.store import NO_NODES, QuadStore, StoreOptions
from fourfold.streaming.streams import import_stream

V = Var


def iris(text):
    return tuple(Iri(x) for x in text.split())


def store_of(spark, *quads, nodes=False, **options):
    store = QuadStore(spark, options=StoreOptions(index_nodes=nodes, **options))
    store.add_quads([iris(q) if isinstance(q, str) else q for q in quads])
    return store


def keys(frame):
    return sorted(tuple(r) for r in frame.collect())


def told(*quads):
    return sorted(tuple(t.key() for t in iris(q)) for q in quads)


FOUR = ("s1 p1 o1 g1", "s1 p2 o2 g1", "s2 p1 o1 g1", "s2 p2 o2 g2")


def test_empty(spark):
    store = QuadStore.create_default(spark)
    assert store.size == 0 and store.get_quads() == [] and store.count() == 0 and store.count(Iri("s")) == 0
    assert store.get_bindings(V("a"), V("b"), V("c"), V("d")) == []
    assert store.count_distinct_terms(["subject"]) == 0 and store.count_distinct_terms([]) == 0
    assert not store.remove_quad(*iris("s p o g")) and store.get_distinct_terms(["graph"]) == []
    assert store.features == {"quotedTripleFiltering": True, "indexNodes": False, "indexDistinctTerms": True}


def test_one_quad(spark):
    store = QuadStore.create_default(spark)
    quad = iris("s p o g")
    assert store.add_quad(*quad) and not store.add_quad(*quad) and store.size == 1
    assert store.add_quad(*iris("s p o2 g")) and store.size == 2
    assert keys(store.match(*quad)) == told("s p o g")
    assert len(store.get_bindings(*quad)) == 1 and store.bindings(*quad).columns == []
    assert store.get_bindings(*iris("s p o none")) == []
    assert store.remove_quad(*quad) and not store.remove_quad(*quad) and store.size == 1
    assert keys(store.quads) == told("s p o2 g")


@pytest.mark.parametrize("k", range(16))
def test_every_shape(spark, k):
    store = store_of(spark, *FOUR)
    quad = iris(FOUR[1])
    pattern = [t if k >> i & 1 else None for i, t in enumerate(quad)]
    slow = [q for q in FOUR if all(t is None or t == x for t, x in zip(pattern, iris(q)))]
    assert keys(store.match(*pattern)) == told(*slow)
    assert store.count(*pattern) == len(slow)
    vars_ = [t or V(n) for t, n in zip(pattern, "wxyz")]
    found = store.bindings(*vars_)
    assert found.columns == [n for t, n in zip(pattern, "wxyz") if t is None]
    assert found.count() == len(slow)


def test_distinct(spark):
    store = store_of(spark, *FOUR)
    for n in range(1, 5):
        for asked in permutations(NAMES, n):
            slow = {tuple(iris(q)[NAMES.index(a)].key() for a in asked) for q in FOUR}
            assert keys(store.distinct_terms(asked)) == sorted(slow)
    assert store.count_distinct_terms([]) == 1 and store.count_distinct_terms(["graph", "predicate"]) == 3
    assert sorted(tuple(r) for r in store.iter_distinct_terms(["graph"])) == [("<g1>",), ("<g2>",)]


def test_changes(spark):
    store = store_of(spark, *FOUR)
    before = store.quads
    assert keys(store.remove_matches(p=Iri("p1"))) == told(FOUR[0], FOUR[2])
    assert keys(store.quads) == told(FOUR[1], FOUR[3]) and before.count() == 4
    assert keys(store.delete_graph("g1")) == told(FOUR[1]) and store.size == 1
    store.add_quads([iris("s p o"), iris("s p o")])
    assert store.size == 2 and keys(store.match(g=DefaultGraph())) == [("<s>", "<p>", "<o>", "")]
    assert store.delete_graph(DefaultGraph()).count() == 1 and store.size == 1
    assert store.remove_matches().count() == 1 and store.size == 0


def test_repeated_variables(spark):
    store = store_of(spark, *(f"{s} {p} {o} t1" for s in ("t1", "t2") for p in ("t1", "t2") for o in ("t1", "t2")))
    assert keys(store.bindings(V("t"), V("t"), V("t"), V("t"))) == [("<t1>",)]
    assert keys(store.bindings(V("ta"), V("tb"), V("ta"), V("tb"))) == [("<t1>", "<t1>"), ("<t2>", "<t1>")]
    assert store.match(V("t"), V("t"), V("t"), V("t")).count() == 8


def said(s, p, *triple):
    return Iri(s), Iri(p), Quoted(*triple)


def test_quoted(spark):
    bob, name = Iri("bob"), Iri("name")
    store = store_of(spark, said("alice", "says", bob, name, Literal('"Bob"')), said("carol", "says", bob, name, Literal('"NotBob"')), said("carol", "thinks", Iri("carol"), name, Literal('"Carol"')))
    asked = Quoted(bob, name, V("x"))
    assert store.match(None, Iri("says"), asked).count() == 2 == store.count(None, Iri("says"), asked)
    assert store.count(o=asked) == 2 and store.count(o=Quoted(bob, name, Literal('"Bob"'))) == 1
    found = store.bindings(V("s"), V("p"), Quoted(V("s"), name, V("n")), DefaultGraph())
    assert [r.asDict() for r in found.collect()] == [{"s": "<carol>", "p": "<thinks>", "n": Literal('"Carol"').key()}]
    whole = store.bindings(Iri("alice"), V("p"), V("o"), V("g")).collect()
    assert [r["o"] for r in whole] == [Quoted(bob, name, Literal('"Bob"')).key()]
    assert store.bindings(V("s"), Iri("says"), Quoted(bob, name, Literal('"Bob"')), DefaultGraph()).columns == ["s"]
    assert store.bindings(V("s"), V("p"), Quoted(V("a"), V("b"), V("c"), Iri("g")), V("g")).count() == 0
    graphs = store.bindings(V("s"), V("p"), Quoted(V("a"), V("b"), V("c"), V("h")), V("h")).collect()
    assert len(graphs) == 3 and {r["h"] for r in graphs} == {""}
    assert store.remove_matches(o=asked).count() == 2 and store.size == 1
    assert store.find_quoted(asked).count() == 2  # the dictionary keeps them
    with pytest.raises(ValueError):
        store.match(o=Quoted(bob, name, bob, Iri("g"))).count()


def test_nested_quoted(spark):
    of = lambda color: Quoted(Iri("Violets"), Iri("haveColor"), Iri(color))
    rows = [(Iri("Alice"), Iri("says"), of("Blue")), (Iri("Alice"), Iri("says"), of("DarkBlue")), (Iri("Bob"), Iri("says"), Quoted(Iri("Alice"), Iri("says"), of("Yellow")))]
    for graph in (DefaultGraph(), Iri("g1")):
        store = store_of(spark, *((*r, graph) for r in rows))
        color = Quoted(Iri("Violets"), Iri("haveColor"), V("color"))
        assert {r["s"] for r in store.get_quads(None, Iri("says"), color)} == {"<Alice>"}
        assert [r["s"] for r in store.get_quads(None, None, Quoted(Iri("Alice"), V("v"), color))] == ["<Bob>"]
        found = store.get_bindings(V("who"), V("verb"), Quoted(V("by"), V("verb"), color), V("g"))
        assert [(r["who"], r["by"], r["color"]) for r in found] == [("<Bob>", "<Alice>", "<Yellow>")]
        assert store.find_quoted(color).count() == 3
        assert store.get_bindings(V("a"), V("b"), Quoted(V("a"), V("b"), V("c")), V("g")) == []
    places = store_of(spark, (of("Red"), Iri("p"), Iri("o"), Iri("g")), (Iri("s"), of("Red"), Iri("o"), Iri("g")), (Iri("s"), Iri("p"), Iri("o"), of("Red")))
    for k in range(4):
        pattern = [None] * 4
        pattern[k] = Quoted(Iri("Violets"), V("x"), V("y"))
        assert places.match(*pattern).count() == (0 if k == 2 else 1)
    twice = store_of(spark, (of("Red"), Iri("p"), of("Red")), (of("Red"), Iri("p"), of("Blue")))
    assert twice.bindings(Quoted(V("f"), V("h"), V("c")), Iri("p"), Quoted(V("f"), V("h"), V("c")), DefaultGraph()).count() == 1


def test_nodes(spark):
    store = store_of(spark, "s1 p1 o1 g1", "s1 p2 o2 g1", "s2 p1 o1 g1", "s2 p2 o1 g1", "s2 p2 o2 g2", "s3 p3 o3 g3", nodes=True)
    store.remove_quad(*iris("s2 p1 o1 g1"))
    store.remove_quad(*iris("s3 p3 o3 g3"))
    assert store.count_nodes(V("g")) == 6 and store.count_nodes(Iri("g1")) == 4 and store.count_nodes(Iri("g2")) == 2
    assert store.count_nodes(Iri("g3")) == 0 and store.count_nodes(Iri("s1")) == 0
    assert keys(store.nodes(Iri("g2"))) == [("<g2>", "<o2>"), ("<g2>", "<s2>")]
    assert len(store.get_nodes()) == 6 == len(list(store.iter_nodes()))
    with pytest.raises(ValueError, match=NO_NODES[:20]):
        store_of(spark, *FOUR).nodes()


def test_dataset(spark):
    store = store_of(spark, *FOUR)
    data = store.as_dataset()
    assert len(data) == 4 == data.size
    assert data.add(*iris("a b c")).delete(*iris(FOUR[0])).size == 4 == store.size
    assert data.has(*iris("a b c")) and not data.has(*iris(FOUR[0]))
    part = data.match(Iri("s2"))
    part.add(*iris("x y z"))
    assert part.size == 3 and store.size == 4 and len(list(data)) == 4


def test_blank_nodes_are_constants(spark):
    store = store_of(spark, (Blank("a"), Iri("p"), Blank("b")), (Iri("a"), Iri("p"), Literal("a")))
    assert store.count(Blank("a")) == 1 and store.count(Blank("x")) == 0


def test_layouts_agree(spark, tmp_path):
    store = store_of(spark, *FOUR, said("alice", "says", *iris("s1 p1 o1")))
    for number, layouts in enumerate([[("graph", "subject", "predicate", "object")], [("object", "graph", "predicate", "subject"), ("subject", "predicate", "object", "graph"), ("predicate", "subject", "graph", "object")]]):
        options = StoreOptions(layouts=layouts, folder=str(tmp_path / f"versions{number}"))
        path = str(tmp_path / f"store{number}")
        QuadStore(spark, store.quads, store.quoted, options).save(path)
        read = QuadStore.load(spark, path, options)
        for pattern in ([], [Iri("s1")], [None, Iri("p1")], [None, None, Iri("o1"), Iri("g1")], [None, None, Quoted(Iri("s1"), V("x"), V("y"))]):
            assert keys(read.match(*pattern)) == keys(store.match(*pattern))
        assert keys(read.distinct_terms(["predicate"])) == keys(store.distinct_terms(["predicate"]))
        old = read.quads
        read.add_quads([iris("n e w")])
        assert read.commit().size == 6 and old.count() == 5 and read.count(Iri("n")) == 1 and read.version == 1


def test_lookups_are_pushed_down(spark, tmp_path, capsys):
    store = store_of(spark, *FOUR)
    store.save(str(tmp_path / "s"))
    QuadStore.load(spark, str(tmp_path / "s")).match(Iri("s1"), None, None, Iri("g1")).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(s,<s1>)" in plan and "EqualTo(g,<g1>)" in plan and "Exchange" not in plan


def test_bindings_need_all_positions(spark):
    with pytest.raises(ValueError, match="bindings need"):
        store_of(spark, *FOUR).bindings(V("a"), None, V("b"), V("c"))
    with pytest.raises(ValueError, match="lack the columns g"):
        store_of(spark, *FOUR).add(spark.createDataFrame([("a", "b", "c")], "s string, p string, o string"))


def leaves(frame):
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_changes_lengthen_the_plan_by_their_rows(spark):
    store, sizes = store_of(spark, *FOUR), []
    for k in range(100):
        store.add_quads([iris(f"s{k % 40} p o{k}")])
        sizes += [leaves(store.quads)] if k in (20, 40, 58) else []
    assert sizes[2] - sizes[1] <= 2 * 18 and sizes[1] - sizes[0] <= 2 * 20 and store.size == 104
    for k in range(3):
        store.remove_matches(o=Iri(f"o{k + 10}"))
    assert leaves(store.quads) <= 2 * 64 + 4 and store.size == 101
    store.remove_matches(o=Quoted(None, None, None))
    store.add_quads([iris("s p1 o1 g1"), iris("s1 p1 o1 g1")])
    assert store.size == 102 and store.count(Iri("s1"), Iri("p1")) == 1


def test_the_latest_change_counts(spark):
    store = store_of(spark, *FOUR)
    for _ in range(3):
        assert store.remove_quad(*iris(FOUR[0])) and not store.has(*iris(FOUR[0]))
        assert store.add_quad(*iris(FOUR[0])) and store.has(*iris(FOUR[0]))
        store.compact()
    assert store.size == 4


def test_quoted_triples_by_every_way_in(spark, tmp_path):
    said = Quoted(Iri("b"), Iri("name"), Literal('x >> "y" <<\n', language="en"))
    rows = [(Iri("a"), Iri("says"), Quoted(said, Iri("p"), Blank("n")))]
    keys_ = spark.createDataFrame([tuple(t.key() for t in (*rows[0], DefaultGraph()))], QUADS_SCHEMA)
    asked, inner = Quoted(Quoted(V("x"), Iri("name"), None), None, None), Quoted(V("x"), Iri("name"), V("y"))
    by_add = QuadStore(spark)
    by_add.add(keys_)
    by_terms = QuadStore(spark)
    by_terms.add_quads(rows)
    by_stream = QuadStore(spark)
    keys_.write.parquet(str(tmp_path / "in"))
    import_stream(by_stream, spark.readStream.schema(QUADS_SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination()
    QuadStore(spark, keys_).save(str(tmp_path / "saved"))
    outer = QuadStore(spark, keys_, options=StoreOptions(inner_quoted=False))
    for store in (by_add, by_terms, by_stream, QuadStore(spark, keys_), QuadStore.load(spark, str(tmp_path / "saved"))):
        assert store.count(o=asked) == 1 and [r["k"] for r in store.find_quoted(inner).collect()] == [said.key()]
    assert outer.find_quoted(inner).isEmpty() and outer.quoted.count() == 1
    bad = QuadStore(spark, spark.createDataFrame([("<a>", "<b>", "<<<a> >>", "")], QUADS_SCHEMA))
    with pytest.raises(Exception, match="INVALID"):
        bad.quoted.collect()


def test_batches(spark):
    store = store_of(spark, *FOUR, said("alice", "says", *iris("s1 p1 o1")))
    asked = spark.createDataFrame([(1, "<s1>", None, None), (2, None, "<p2>", None), (3, "<s2>", "<p2>", None), (4, None, None, "<s1>"), (5, "<none>", None, None)], "n int, s string, p string, o_s string")
    found = Counter((r["n"], r["s"], r["p"]) for r in store.match_many(asked).collect())
    assert found == {(1, "<s1>", "<p1>"): 1, (1, "<s1>", "<p2>"): 1, (2, "<s1>", "<p2>"): 1, (2, "<s2>", "<p2>"): 1, (3, "<s2>", "<p2>"): 1, (4, "<alice>", "<says>"): 1}
    assert store.match_many(asked.limit(0)).columns == ["n", "s", "p", "o", "g"] and store.match_many(asked.limit(0)).count() == 0
    counts = {r["p"]: r["n"] for r in store.count_many(spark.createDataFrame([("<p1>",), ("<none>",)], "p string")).collect()}
    assert counts == {"<p1>": 2, "<none>": 0}
    with pytest.raises(ValueError, match="binds nothing"):
        store.match_many(spark.createDataFrame([(1, None)], "n int, s string"))


def test_quoted_layouts():
    assert quoted_layout(()) == ("k",) == quoted_layout(("k",)) and quoted_layout(("s",)) == ("s", "p", "o") == quoted_layout(("p", "s"))
    assert quoted_layout(("p",)) == ("p", "o", "s") and quoted_layout(("o",)) == ("o", "s", "p") == quoted_layout(("s", "o"))
