"""Keys are injective, and their parts come back in Python and as columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fourfold.functions.terms import Blank, DefaultGraph, Iri, Literal, Quoted, Var, escape, literal_key, open_term, parse, unescape
from fourfold.operators.dictionary import term_table

TERMS = [
    Iri("s"), Blank("s"), Literal("s"), Iri("ex:a/b?c#d"), Literal("abc"), Literal("def"), Literal("abc", datatype="ex:d"), Literal("abc", language="en_us", direction="ltr"),
    Literal("abc", language="en_us", direction="rtl"), Literal("abc", language="en"), Literal("1", datatype="xsd:integer"), Literal("01", datatype="xsd:integer"), Literal(""),
    Literal('a "quote", a \\ and\na line\r'), Literal('x"^^<ex:d>'), Literal('x"@en'), Literal("\\n"), Literal("a\x00b"), Literal('\\\\"\\'), Literal("<<a b c>>"), DefaultGraph(),
    Quoted(Iri("a"), Iri("b"), Literal("c d")), Quoted(Quoted(Iri("a"), Iri("b"), Blank("c")), Iri("p"), Quoted(Iri("a"), Iri("b"), Quoted(Iri("x"), Iri("y"), Literal(">> z", language="en")))),
]
text = st.text(alphabet='ab\\"\n\r<>@^-é ', max_size=12)
name = st.text(alphabet="abé:/#", min_size=1, max_size=6)
plain = st.one_of(name.map(Iri), name.map(lambda x: Blank(x.replace("<", ""))), text.map(Literal), st.tuples(text, name).map(lambda x: Literal(x[0], datatype=x[1])), st.tuples(text, st.sampled_from(["en", "de"]), st.sampled_from([None, "ltr"])).map(lambda x: Literal(x[0], language=x[1], direction=x[2])))
terms = st.recursive(plain, lambda t: st.tuples(t, t, t).map(lambda x: Quoted(*x)), max_leaves=6)


def test_terms_are_distinct():
    assert len({t.key() for t in TERMS}) == len(TERMS)
    assert [parse(t.key()) for t in TERMS] == TERMS


@settings(max_examples=300, deadline=None)
@given(terms, terms)
def test_round_trip(a, b):
    assert parse(a.key()) == a
    assert (a.key() == b.key()) == (a == b)


@given(text)
def test_escapes(value):
    assert unescape(escape(value)) == value


def test_what_is_no_term():
    for bad in (Iri("a b"), Iri("a>"), Blank(""), Var("x"), Quoted(Iri("a"), Iri("b"), Iri("c"), Iri("g"))):
        with pytest.raises(ValueError):
            bad.key()
    for bad in ("x", "<<<a> <b>", "<a> "):
        with pytest.raises(ValueError):
            parse(bad)


def test_open_terms():
    assert open_term(None) and open_term(Var("x")) and open_term(Quoted(Iri("a"), Iri("b"), Quoted(Iri("a"), Var("x"), Iri("c"))))
    assert not open_term(Blank("x")) and not open_term(Quoted(Iri("a"), Iri("b"), Iri("c")))


def test_columns(spark):
    found = {r["key"]: r for r in term_table(spark.createDataFrame([(t.key(),) for t in TERMS], "key string")).collect()}
    for t in TERMS:
        row = found[t.key()]
        assert row["kind"] == {Iri: "iri", Blank: "blank", Literal: "literal", DefaultGraph: "default", Quoted: "quoted"}[type(t)]
        if isinstance(t, Literal):
            assert (row["value"], row["datatype"], row["language"], row["direction"]) == (t.value, t.datatype, t.language, t.direction)
        elif isinstance(t, Iri):
            assert row["value"] == t.value
    values = ['a "b" \\ \n\r', "", "plain"]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(literal_key(__import__("pyspark").sql.functions.col("v"))).collect()]
    assert keys == [Literal(v).key() for v in values]
