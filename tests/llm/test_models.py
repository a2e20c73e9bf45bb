"""Operators 8, 9 and 10: learned models, and what doesn't depend on learning against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fourfold.llm import language_id, queries, toxicity, url_filter
from fourfold.llm.url_filter import RULES, Rule, judged

MANY = "/root/testdata/sf0.01"


def best_by_force(scores):
    """The value of the best labelling."""
    top = -math.inf
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        switches = sum(a != b for a, b in zip(path, path[1:]))
        top = max(top, sum(float(scores[k, x]) for k, x in enumerate(path)) - language_id.SWITCH * switches)
    return top


def value(scores, path):
    return sum(float(scores[k, x]) for k, x in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 0)] * 3), min_size=1, max_size=7), min_size=1, max_size=4))
def test_viterbi_by_force(texts):
    scores = [np.array(t, np.float32) * 2 for t in texts]
    for s, label in zip(scores, language_id.viterbi(scores)):
        assert value(s, label) == pytest.approx(best_by_force(s))
    sizes = np.array([len(s) for s in scores])
    first = np.cumsum(sizes) - sizes
    flat, owner = np.concatenate(scores), np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(flat.astype(float), first, axis=0)
    for s, t, fine in zip(scores, total, language_id.constant(total, flat, owner, first)):
        if fine:
            assert t.max() == pytest.approx(best_by_force(s))


def test_language(spark):
    docs = spark.read.parquet(f"{MANY}/documents.parquet")
    found = {r["doc_id"]: r for r in language_id.languages(docs, with_spans=True).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert [found[r["doc_id"]]["held_out"] for r in held] == [True] * len(held)
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.96
    assert all(0 <= r["score"] <= 1 for r in found.values())
    for r in rows:
        spans = found[r["doc_id"]]["spans"]
        assert not spans or (spans[0]["first"], spans[-1]["after"]) == (0, len(r["text"].split()))
        assert all(a["after"] == b["first"] for a, b in zip(spans, spans[1:]))


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{MANY}/documents.parquet")
    model = language_id.learned(docs)
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 900").collect()}
    both = " ".join(text["en"].split()[:80] + text["de"].split()[:120])
    frame = spark.createDataFrame([(1, both)], "doc_id long, text string")
    (row,) = language_id.languages(frame, model, with_spans=True).collect()
    assert row["lang_pred"] == "de" and {"en", "de"} <= {s["lang"] for s in row["spans"]}


def test_language_of_odd_rows(spark):
    rows = [(1, None, "en", 0), (2, " 12 ... !", "en", 0), (3, "", None, 0), (None, "the of and", "en", 0), (5, "漢字 かな", None, 0), (6, "the and of", "en", 0), (6, "the and of", "en", 0), (7, "der die das", "de", 0), (8, "the " * 50_000, None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = language_id.languages(frame).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[5][1] == 0.0 and by[8][0] == "en"
    assert {r["doc_id"] for r in language_id.with_language(frame).collect()} >= {None, 6, 7, 8}
    assert language_id.with_language(frame).columns == frame.columns
    assert language_id.languages(frame.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.languages(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_all_of_a_long_run_is_judged(spark):
    docs = spark.read.parquet(f"{MANY}/documents.parquet")
    model = language_id.learned(docs)
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 900").collect()}
    words = {lang: [w for w in x.split() if w.isalpha()] for lang, x in text.items()}
    joined = "/".join(words["en"][:15] + words["de"][:80])
    frame = spark.createDataFrame([(1, joined), (2, joined.replace("/", "\u200b"))], "doc_id long, text string")
    for row in language_id.languages(frame, model, with_spans=True).collect():
        assert row["lang_pred"] == "de" and row["spans"][-1]["lang"] == "de" and row["spans"][-1]["end"] == len(joined)
        assert [a["end"] for a in row["spans"][:-1]] == [b["begin"] for b in row["spans"][1:]]


def test_a_run_without_spaces_is_judged_whole(spark):
    rows = [(k, "漢字" * 30, "zh") for k in range(8)] + [(20 + k, "仮名" * 30, "ja") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = spark.createDataFrame([(1, "漢字" * 40 + "仮名" * 200)], "doc_id long, text string")
    (row,) = language_id.languages(frame, language_id.learned(docs), with_spans=True).collect()
    assert row["lang_pred"] == "ja" and [s["lang"] for s in row["spans"]] == ["zh", "ja"]


def test_repeated_texts_are_drawn_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS", 50)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same old text").alias("text"), F.lit("en").alias("lang"))
    model = language_id.learn(rows.unionByName(spark.createDataFrame([(9999, "ein anderer satz", "de")], rows.schema)))
    bucket = slow_bucket(b"^the", 4)
    share = np.exp(model.scores[bucket, model.languages.index("en")])
    assert share > 0.5 / (1 << 16) * 10  # drawn at all, though all rows have one text
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(rows.unionByName(spark.createDataFrame([(9999, "ein anderer satz", "de")], rows.schema)))


def test_pieces():
    assert [w for w, _ in language_id.pieces("Don't/STOP_now")] == ["dont", "stop", "now"]
    assert language_id.pieces("漢字かな") == [("漢字", 0), ("かな", 2)]
    assert [w for w, _ in language_id.pieces("हिन्दी")] == ["".join(c for c in "हिन्दी" if c.isalpha())]
    assert language_id.pieces("12") == [("", 0)] and len("".join(w for w, _ in language_id.pieces("é" * 1000))) == 1000


def test_scripts():
    assert [language_id.NAMES[language_id.script(w)] for w in ("abc", "Жук", "γη", "漢", "かな", "한글", "שלום")] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew"]
    assert language_id.script("12") == -1


def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{MANY}/documents.parquet"), spark.read.parquet(f"{MANY}/labels.parquet")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] for i in held)
    hits = Counter((truth[i], found[i]["predicted"]) for i in held)
    assert hits[1, 1] >= 0.6 * (hits[1, 0] + hits[1, 1]) and hits[0, 1] <= 0.02 * (hits[0, 0] + hits[0, 1])


def slow_gain(model, text):
    """Windows of 16 coded words, compressed one by one with each dictionary."""
    coded = [hashlib.blake2b(w.encode(), digest_size=12).digest() for w in re.findall(r"[^\s.,;:!?|]+", text.lower())]
    toxic, ordinary = toxicity.compressor(model.toxic), toxicity.compressor(model.ordinary)
    total = 0
    for k in range(0, len(coded), 16):
        window = b"".join(coded[k : k + 16])
        total += max(0, len(ordinary.compress(window)) - len(toxic.compress(window)) - 1)
    return total


def test_toxicity_scores_by_plain_calls(spark):
    docs, labels = spark.read.parquet(f"{MANY}/documents.parquet"), spark.read.parquet(f"{MANY}/labels.parquet")
    model = toxicity.learn(docs, labels)
    assert len(model.toxic) == len(model.ordinary) and model.toxic != model.ordinary
    some = docs.where("doc_id % 9 = 0")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(some, labels, model=model).collect()}
    for row in some.collect():
        slow = 1 / (1 + math.exp(-(model.slope * min(slow_gain(model, row["text"] or ""), 40) + model.offset)))
        assert abs(found[row["doc_id"]] - slow) < 1e-9


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{MANY}/documents.parquet"), spark.read.parquet(f"{MANY}/labels.parquet")
    held = toxicity.held_out(labels["doc_id"])
    turned = labels.withColumn("toxic", F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, turned)


def slow_bucket(gram, n):
    return ((int.from_bytes(gram, "little") + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48


def slow_buckets(word):
    """The buckets of all n-grams up to 4 of a word between bounds, and of the whole word."""
    held = f"^{word}$".encode()
    grams = [slow_bucket(held[k : k + n], n) for n in range(1, 5) for k in range(len(held) - n + 1)]
    return [*grams, (zlib.crc32(held) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48]


def test_language_scores_by_force(spark):
    rows = [(k, f"{a} {b} {a}", lang) for k, (a, b, lang) in enumerate([("the", "cats", "en"), ("die", "Katzen", "de"), ("ein", "straße", "de"), ("жук", "мир", "ru"), ("o", "x" * 130, "en")])]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text"))
    assert model.languages == ["de", "en", "ru"]
    counts = np.full((1 << 16, 3), 0.5)
    for _, text, lang in rows:
        for run in text.split():
            for word, _ in language_id.pieces(run):
                for bucket in slow_buckets(word):
                    counts[bucket, model.languages.index(lang)] += 1
    scores = np.log(counts / counts.sum(axis=0))
    assert np.allclose(model.scores, scores, atol=1e-5)
    words = ["the", "katzen", "straße", "мир", "", "x", "漢字", "theme"]
    found, sizes = model.of_words(words)
    for word, got, size in zip(words, found, sizes):
        writes = {"л": [False, False, True], "l": [True, True, False]}.get("" if not word else "л" if "а" <= word[0] <= "я" else "l" if word[0] < "\u0370" else "")
        if writes is None:
            assert not got.any() and size.tolist() == [len(word), 0]
            continue
        sums = 0.5 * sum(scores[b] for b in slow_buckets(word))
        best = max(x for x, w in zip(sums, writes) if w)
        assert np.allclose(got, [max(x - best, -6.0) if w else -6.0 for x, w in zip(sums, writes)], atol=1e-3)
        assert size.tolist() == [len(word)] * 2


def toxic_rows(n=240):
    clean = [f"plain words of text number w{k} and more of them {k % 7} so on" for k in range(n)]
    return [(k, t + (" nasty horrid" if k % 3 == 0 else "")) for k, t in enumerate(clean)]


def test_toxicity_of_odd_rows(spark):
    rows = toxic_rows() + [(1000, None), (1001, ""), (1002, "... !"), (None, "some nasty text"), (1003, "fine " * 40_000 + "nasty horrid"), (3, "plain again")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in toxic_rows()] + [(5, 1), (6, None), (None, 1), (77777, 1), (8, 7)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"] < 0.5
    assert by[1003]["score"] > by[1000]["score"]
    assert by[None]["held_out"] is False
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0} and len({r["score"] for r in none}) == 1
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


URLS = [
    None, "", "no scheme", "http://net/", "http://NET/x", "https://a.example.net/en/1", "https://example.net/EN/1", "http://example.net", "http://xnet/", "http://a.b.example.com/de/?q=1",
    "http://example.com/de", "http://x.org/fr/a#b", "http://x.org?fr/", "a://b://c/d", "http://É.org/fr/", "http://ÀB.Net/é/1", "://", "http:///path", "http://h:80/p?x&y;z%20#f", "http://org/fr/\n?",
]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def slow_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules_by_force(spark):
    frame = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x")], "page_id long, url string, host string")
    found = judged(frame).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url = URLS[4] if r["page_id"] is None else URLS[r["page_id"]]
        rule = slow_rule(*slow_parts(url))
        assert (r["host"], r["path"], r["rule"]) == (*slow_parts(url), rule and rule.text)
        assert r["verdict"] in ("allow", "block")
        if rule:
            assert r["verdict"] == ("block" if rule.block else "allow")
    assert judged(frame.limit(0)).count() == 0


def test_trees_learn(spark):
    urls = [f"http://{'bad' if k % 2 else 'ok'}{k}.example/{'1234567890' * (k % 2)}/{k}" for k in range(300)]
    rules = tuple(Rule(f"{u.split('/')[2]}/", bool(k % 2)) for k, u in enumerate(urls[:150]))
    found = judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    rest = [r for r in found if r["rule"] is None]
    assert len(rest) == 150 and np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in rest]) > 0.95
    one = judged(spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.io/")], "page_id long, url string")).collect()
    assert {r["verdict"] for r in one} == {"block"}


@pytest.mark.parametrize("folder", [MANY, "/root/testdata/sf0.001"])
def test_rules_in_sql(spark, folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    told = connection.execute(queries.oracle_sql()["url_rules"]).fetchall()
    judged_ = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in queries.op10_url_filter(spark, folder).collect()]
    assert Counter(told) == Counter(judged_) == Counter(tuple(r) for r in queries.url_rules(spark, folder).collect())


def test_statistics_leave_out_the_own_label(spark):
    """Suffixes of one labelled row each: a rate that held the row's own label would tell it."""
    rows = [(k, f"http://h{k}.com/{'de' if k % 2 else 'fr'}/x{k}") for k in range(400)] + [(1000 + k, f"http://u{k}.info/") for k in range(50)]
    rules = (Rule("com/de/", True), Rule("com/fr/", False))
    found = {r["page_id"]: r for r in judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(0.2 < found[1000 + k]["score"] < 0.9 for k in range(50)) and len(found) == 450


def test_entropy(spark):
    texts = ["", "a", "abab", "http://x.org/é?a=b.c[d]", "aaab\\."]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(url_filter.entropy(F.col("t"))).collect()
    told = [-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0 for t in texts]
    assert [r[0] for r in found] == pytest.approx(told)
    assert urlsplit("http://a/b").netloc == "a"


def test_very_long_urls(spark):
    rows = [(1, "http://example.com/de/" + "a1-" * 100_000 + "?q=" + "z" * 50_000), (2, "http://" + "h" * 100_000 + ".org/fr/x"), (3, "x" * 200_000), (4, "http://b.net/")]
    found = {r["page_id"]: r for r in judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[1]["rule"] == "example.com/de/" and found[2]["rule"] == "org/fr/" and (found[3]["host"], found[3]["path"]) == ("", "") and found[4]["verdict"] == "block"
    assert len(found[1]["path"]) == 4 + 300_000 and len(found[2]["host"]) == 100_004
