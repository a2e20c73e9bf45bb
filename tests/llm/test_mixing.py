"""Operator 5: budgets, prefixes and whole rows."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fourfold.llm.encoders import load, public_path
from fourfold.llm.mixing import NONE, budgets, mix, shared

WORD = public_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, key string, epoch int, _level_0 string"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1000), st.lists(st.tuples(st.sampled_from([0.0, 1.0, 2.0, 5.5]), st.integers(0, 300)), max_size=6))
def test_shares(total, wants):
    out = shared(total, wants)
    assert all(0 <= x <= c for x, (_, c) in zip(out, wants))
    assert sum(out) == min(total, sum(c for _, c in wants))
    open_ = [(x / w) for x, (w, c) in zip(out, wants) if w and x < c]
    assert not open_ or max(open_) - min(open_) <= 1 + len(wants)


def test_shortage_goes_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert budgets(leaves, 100, lambda p: 1.0, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    leaves[("a", "y")] = 20  # the whole subtree falls short: now its sibling gets the rest
    assert budgets(leaves, 100, lambda p: 1.0, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}
    assert budgets(leaves, 100, lambda p: 1.0, 2) == {("a", "x"): 20, ("a", "y"): 30, ("b", "z"): 50}
    assert budgets({}, 5, lambda p: 1.0, 1) == {}


def rows_of(n=160):
    rows = [(k, "word " * (k % 13) + f"w{k}", ["en", "de", None][k % 3], f"s{k % 2}", "k", 0, "x") for k in range(n)]
    return rows + [(7, rows[7][1], *rows[7][2:]), (None, "no id", "en", "s0", "k", 0, "x"), (900, None, "en", "s0", "k", 0, "x"), (901, "", "fr", "s9", "k", 0, "x")]


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (1.0, 1), (1.0, 3), (0.0, 2)])
def test_prefixes(spark, share, epochs):
    rows = rows_of()
    weight = lambda path: 6.0 if path[0] == "de" else 1.0
    found = mix(spark.createDataFrame(rows, SCHEMA).repartition(3), levels(), weight, WORD, share, epochs).collect()
    n = dict(zip([r[0] for r in rows], load(WORD).lengths([r[1] or "" for r in rows])))
    available, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        available[r[2] or NONE, r[3] or NONE] += n[r[0]]
    for r in found:
        assert r["n_tokens"] == n[r["doc_id"]]
        taken[r["lang"], r["source"]] += r["n_tokens"]
    goal = budgets(available, int(share * sum(available.values())), weight, epochs)
    for leaf, budget in goal.items():
        assert budget - 2 * max(n.values()) - 1 < taken[leaf] <= budget
    per = defaultdict(list)
    for r in found:
        per[r["doc_id"]].append(r["epoch"])
    twice = {7}
    assert all(sorted(e)[-1] + 1 == len(set(e)) <= epochs or not n[i] for i, e in per.items())
    assert all(len(e) == len(set(e)) * (2 if i in twice else 1) for i, e in per.items())


def test_whole_rows(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCHEMA)
    found = mix(frame, levels(), lambda p: 1.0, WORD, 0.5, whole_rows=True)
    assert found.columns == frame.columns
    ids = sorted(str(r["doc_id"]) for r in found.collect())
    assert ids == sorted(str(r["doc_id"]) for r in mix(frame, levels(), lambda p: 1.0, WORD, 0.5).collect())
    assert set(map(tuple, found.collect())) <= set(rows)
    assert mix(frame.limit(0), levels(), lambda p: 1.0, WORD, 0.5).count() == 0


def test_too_many_leaves(spark, monkeypatch):
    monkeypatch.setattr("fourfold.llm.mixing.MOST_LEAVES", 2)
    with pytest.raises(ValueError, match="more than 2 leaves"):
        mix(spark.createDataFrame(rows_of(), SCHEMA), levels(), lambda p: 1.0, WORD, 0.5)


def test_very_long_texts(spark):
    rows = [(1, "long words again " * 200_000, "en", "a"), (2, "short", "en", "a"), (3, "x" * 300_000, "de", "b"), (4, "short too", "de", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, lambda path: 1.0, WORD, share=1.0).collect()
    tokens = {r["doc_id"]: r["n_tokens"] for r in taken}
    assert tokens == {i: len(load(WORD).ids([text])[0]) for i, text, *_ in rows}


def test_null_ids_are_cut_by_their_texts(spark):
    """A leaf of null ids is cut like any other; equal texts go together, and whole rows are the same rows."""
    rows = [(None, f"text {k % 90}", "en", "s", "k", 0, "x") for k in range(120)] + [(None, None, "en", "s", "k", 0, "x")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [r["text"] for r in mix(frame, levels(), lambda p: 1.0, WORD, 0.5, whole_rows=True).collect()]
    n = dict(zip([r[1] for r in rows], load(WORD).lengths([r[1] or "" for r in rows])))
    total = sum(n[r[1]] for r in rows)
    assert 0.5 * total - 2 * max(n.values()) - 1 < sum(n[t] for t in found) <= 0.5 * total
    every = [r[1] for r in rows]
    assert all(found.count(t) == every.count(t) for t in set(found))
    assert len(found) == mix(frame, levels(), lambda p: 1.0, WORD, 0.5).count()
