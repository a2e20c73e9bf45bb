"""Operators 3, 4 and 6 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fourfold.llm import embedding_dedup, simhash
from fourfold.llm.components import components
from fourfold.llm.decontaminate import contaminated, without_contaminated, words_of
from fourfold.llm.embedding_dedup import near_vectors
from fourfold.llm.simhash import masks, near_duplicates, one_of_each_group


def grouped(nodes, links):
    """The smallest node reachable, by brute force."""
    least = {n: n for n in nodes}
    change = True
    while change:
        change = False
        for a, b in links:
            low = min(least[a], least[b])
            change |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    rng.shuffle(links)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == grouped({x for ab in real for x in ab}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_print(text):
    """The fingerprint by its definition, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_by_force(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[:k] if (x ^ y).bit_count() <= 4]
    least = grouped({i for i, _ in prints}, links)
    return sorted((i, f"{x:016x}", least[i]) for i, x in prints)


def near_texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\x0b\n"), (3, "ONE two"), (4, "one TWO"), (5, "É one\xa0two three four five"), (6, "x " * 5000)]
    for base in range(12):
        text = [rng.choice(words) for _ in range(600)]
        for k in range(6):
            changed = list(text)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((100 + base * 10 + k, " ".join(changed)))
    return rows


def test_masks_cover():
    rng = random.Random(2)
    for radius in (1, 2, 4, 5, 6):
        found = masks(radius)
        assert len(found) == 2 ** (radius + 1) - 2 and all((m % 2**64).bit_count() == 32 for m in found)
        for _ in range(500):
            apart = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & apart == 0 for m in found)


def test_simhash_by_force(spark):
    rows = near_texts()
    frame = spark.createDataFrame([(i, t, "a", i) for i, t in rows], "doc_id long, text string, fp string, component_id long")
    found = near_duplicates(frame).collect()
    assert sorted(tuple(r) for r in found) == simhash_by_force(rows)


def test_simhash_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 3)
    monkeypatch.setattr(simhash, "LOOKED_AT", 1)
    rows = near_texts()
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == simhash_by_force(rows)


def test_simhash_forest_is_whole():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.concatenate([b ^ np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(40)], np.uint64) for b in base])
    a, b = simhash.forest(fp, 4)
    force = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4]
    assert grouped(range(len(fp)), list(zip(a.tolist(), b.tolist()))) == grouped(range(len(fp)), force)


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (8, "a b c d e"), (None, "nobody else says this here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(frame).collect()), key=str)
    assert found == sorted([(None, 8), (9, 8), (9, 8), (8, 8), (None, None)], key=str)
    kept = sorted((tuple(r) for r in one_of_each_group(frame).collect()), key=str)
    assert kept == sorted([rows[3], rows[0], rows[4]], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies_go(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows, told = [], {}
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append((base, " ".join(text)))
        changed = list(text)
        for _ in range(rng.randint(0, max(1, len(text) // 70))):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        rows.append((1000 + base, " ".join(changed)))
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        told[1000 + base] = len(a & b) / len(a | b)
        rows.append((2000 + base, " ".join(rng.sample(text, len(text)))))  # the same words in another order
    kept = {r["doc_id"] for r in one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in range(60)} | {2000 + k for k in range(60)} <= kept
    near = [k for k, x in told.items() if x >= 0.8]
    assert len(near) > 30 and sum(k in kept for k in near) <= 0.15 * len(near)
    assert not [k for k, x in told.items() if x < 0.6 and k not in kept]


def kept_of(spark, texts):
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in one_of_each_group(frame).collect()}


def test_near_copies_among_many_like_fingerprints_go(spark):
    rng = random.Random(21)
    base, texts = [f"w{k}" for k in range(500)], []
    for k in range(60):  # the same words but one, in another order; then a copy with another word changed
        text = rng.sample(base, len(base))
        text[rng.randrange(500)] = f"a{k}"
        texts += [text, list(text)]
        texts[-1][rng.randrange(500)] = f"b{k}"
    assert kept_of(spark, texts) == set(range(0, 120, 2))


def test_texts_of_the_same_words_are_compared_with_each_other(spark):
    rng = random.Random(22)
    texts = []
    for k in range(8):  # the second has the words of the first in another order, the third is the second with paragraphs moved
        first = [f"w{k}.{x}" for x in range(400)]
        other = rng.sample(first, len(first))
        texts += [first, other, [w for part in rng.sample(range(7), 7) for w in other[60 * part : 60 * part + 60]]]
    assert kept_of(spark, texts) == {k for k in range(24) if k % 3 < 2}


def test_near_copies_go_at_the_least_similarity(spark):
    rng = random.Random(23)
    texts, near = [], []
    for k in range(300):
        text = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(50, 200))]
        copy = list(text)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 50)):
            copy[at] = f"v{rng.randrange(3000)}"
        a, b = shingles(" ".join(text)), shingles(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            near.append(len(texts) + 1)
            texts += [text, copy]
    kept = kept_of(spark, texts)
    assert len(near) > 100 and sum(k in kept for k in near) <= 0.05 * len(near)


def test_short_texts_are_told_apart():
    def of(*numbers):
        return simhash.sketch(np.array(numbers, "<u8"))

    one, two = of(5), of(6)
    two = one[:-8] + two[-8:]  # a chance agreement of the bins
    x, y = (np.frombuffer(z, "<i8")[None] for z in (one, two))
    assert simhash.alike(x, x).all() and not simhash.alike(x, y).any()


def slow_score(words, item):
    """Smith-Waterman by its definition."""
    best, above = 0, [0] * (len(words) + 1)
    for w in item:
        row = [0]
        for k, x in enumerate(words):
            row.append(max(0, above[k] + (2 if w == x else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(item)) if best >= 2 * min(8, len(item)) else 0


def leaks():
    rng = random.Random(5)
    common = ["the", "of", "and", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"v{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 50)))) for k in range(12)]
    items += [(50, None), (51, " ..."), (52, "Tiny item"), (53, items[0][1]), (54, "the of and to the of and to")]
    docs = [(1000 + k, " ".join(word() for _ in range(300))) for k in range(25)] + [(1, None), (2, ""), (3, "the " * 4000)]
    for k in range(40):
        text = items[k % 12][1].split()
        for _ in range(int(len(text) * 0.06 * (k // 8))):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [word()], [text[at], word()]])
        around = [word() for _ in range(rng.randrange(200))]
        docs.append((k + 10, " ".join(around) + " " + " ".join(text).upper() + ", " + " ".join(around[:50])))
    docs += [(90, "x tiny, ITEM y"), (91, items[3][1] + " " + items[4][1])]
    return docs, items


def test_contaminated_by_force(spark):
    docs, items = leaks()
    told = {(d, i): s for d, t in docs for i, x in items if words_of(x or "") and (s := slow_score(words_of(t or ""), words_of(x))) >= 0.5}
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(frame, tests).collect()}
    assert found == pytest.approx(told)
    assert len(told) > 30
    kept = {r["doc_id"] for r in without_contaminated(frame, tests).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_items_in_blocks(spark, monkeypatch):
    docs, items = leaks()
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, contaminated(frame, tests).collect()))
    monkeypatch.setattr("fourfold.llm.decontaminate.BLOCK_BYTES", 600)
    assert sorted(map(tuple, contaminated(frame, tests).collect())) == once


def test_a_passage_that_all_share_is_found(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    frame = spark.createDataFrame([(k, f"{passage} a{k}") for k in range(50)], "doc_id long, text string")
    found = contaminated(frame, spark.createDataFrame([(0, passage)], "item_id long, text string"))
    assert found.count() == 50 and found.select("score").distinct().collect()[0][0] == 1.0


@pytest.mark.parametrize("copies, others", [(1, 199), (3, 0), (20, 300)])
def test_edited_copies_alone_are_found(spark, copies, others):
    passage = [f"p{k}" for k in range(30)]
    edited = " ".join("changed" if k % 5 == 3 else w for k, w in enumerate(passage))
    rows = [(k, f"a{k} {edited} b{k}") for k in range(copies)] + [(1000 + k, f"nothing of it {k}") for k in range(others)]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(passage))], "item_id long, text string"))
    told = slow_score(words_of(rows[0][1]), words_of(" ".join(passage)))
    assert told >= 0.5 and {r["doc_id"]: r["score"] for r in found.collect()} == pytest.approx(dict.fromkeys(range(copies), told))


def test_no_items_or_documents(spark):
    some, none = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    assert contaminated(some, items.limit(0)).count() == 0
    assert without_contaminated(some, items.limit(0)).count() == 1


def clusters(seed=0, n=700, dims=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, dims))
    rows = [base[k % 60] + rng.standard_normal(dims) * rng.choice([0.02, 0.15, 0.25, 0.6]) for k in range(n)]
    rows += [rows[0]] * 5 + [rows[1] * 3.0]
    return [(k + 10, [float(np.float32(v)) for v in x]) for k, x in enumerate(rows)]


def vectors_by_force(rows):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids = list(unit)
    all_ = np.stack([unit[i] for i in ids])
    near = all_ @ all_.T >= 0.95 - 1e-12
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b]
    least = grouped(ids, links)
    return {i: (int(near[k].sum()) - 1, least[i], least[i] == i) for k, i in enumerate(ids)}, len(links)


@pytest.mark.parametrize("together", [4096, 20])
def test_vectors_by_force(spark, monkeypatch, together):
    monkeypatch.setattr(embedding_dedup, "TOGETHER", together)
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    rows = clusters()
    told, links = vectors_by_force(rows)
    bad = [(1, None), (2, []), (3, [0.0] * 24), (4, [float("nan")] * 24), (5, [None] + [1.0] * 23), (6, [float("inf")] + [1.0] * 23), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<float>, n_links int")
    found = near_vectors(frame).collect()
    assert len(found) == len(rows) + len(bad)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert all(by[i] == (0, i, i is not None) for i, _ in bad)
    assert links > 1000
    got = sum(by[i][0] for i, _ in rows) / 2
    assert 0.998 * links <= got <= links
    assert sum(by[i] == told[i] for i, _ in rows) >= 0.97 * len(rows)
    assert near_vectors(frame.limit(0)).count() == 0


def test_counted_windows():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((70, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    need = embedding_dedup.enough(embedding_dedup.LINES, 5e-4)
    at = unit @ embedding_dedup.lines_of(16, embedding_dedup.LINES, 7)
    width = embedding_dedup.HALF_WINDOW * np.sqrt(2 - 1.9) * (1 + 1e-9)
    told = (np.abs(at[:, None] - at[None]) <= width).sum(axis=2) >= need
    found = np.unpackbits(embedding_dedup.colliding(unit, 0.95, 5e-4, 6), axis=1, bitorder="little", count=70).astype(bool)
    assert (found == told).mean() > 0.999


def test_a_very_long_item_is_found(spark):
    words = [f"w{(k * 7919) % 5003}" for k in range(3000)]
    copy = [w if k % 9 else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(["so"] * 500 + copy + ["on"] * 500)), (2, " ".join(words[:900])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()] == [(1, 7)]


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (2, [0.0, 1.0])]
    for kind in ("float", "double"):
        found = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").coalesce(1)).collect()
        links = sorted((r["vec_id"] or 0, r["n_links"]) for r in found)
        assert len(found) == len(rows) and [x for x in links if x[1]] == [(1, 1), (2, 1), (2, 1)]
