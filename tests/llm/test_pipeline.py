"""The pipeline: what each stage keeps, and the same rows from run()."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from fourfold.llm.decontaminate import contaminated
from fourfold.llm.encoders import load, public_path
from fourfold.llm.simhash import near_duplicates


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    kept = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], sf_dir).write.parquet(str(folder / name))
        kept.append(spark.read.parquet(str(folder / name)))
    return kept


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_keep_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(sorted(x.columns) == sorted(stages[0].columns) for x in stages[1:-1])
    rows = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    assert all(rows[r["doc_id"]] == r["text"] for x in stages[1:-1] for r in x.collect())


def test_near_duplicates_go(stages):
    left = ids(near_duplicates(stages[1]).where("doc_id = component_id"))
    kept = ids(stages[2])
    assert set(kept) <= set(left) and len(left) < stages[1].count()
    assert len(kept) > 0.9 * len(left) and 0 in kept  # near copies beyond the fingerprint's radius go as well


def test_contaminated_documents_go(spark, stages, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {r["doc_id"] for r in contaminated(stages[2], items).collect()}
    assert ids(stages[3]) == sorted(set(ids(stages[2])) - found) and found


def test_mixture_takes_documents_once(stages):
    taken = ids(stages[4])
    assert len(taken) == len(set(taken)) and set(taken) < set(ids(stages[3]))


def test_token_files(stages):
    texts = sorted((r["doc_id"], r["text"]) for r in stages[4].collect())
    told, start = [], 0
    for (i, _), found in zip(texts, load(public_path("word_bpe_49k.json")).ids([t for _, t in texts])):
        data = np.append(found, 2).astype("<u4")
        told.append((i, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert sorted(tuple(r) for r in stages[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == told


def test_run(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1].collect()))


WORDS = "the old house on the hill was sold to a young couple who painted every door green and planted apple trees behind the barn before winter came".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node int, `gone_id` int, `_row` string"


def odd_documents():
    texts = [" ".join(WORDS[(k * 7 + j * (k + 3)) % len(WORDS)] + (f"x{k}" if j % 5 == 0 else "") for j in range(40)) for k in range(30)]
    rows = [(k, t, "en", "web0", len(t), k, 0, "r") for k, t in enumerate(texts)]
    rows += [(100 + k, t, "en", None, None, None, None, None) for k, t in enumerate(texts[:3])]  # exact copies
    rows += [(5, texts[5], "en", "web0", 1, 5, 0, "r"), (6, "another text with the sixth id " + texts[9], None, "web1", 1, 6, 0, "r")]  # ids that repeat
    rows += [(None, texts[1], "en", "web0", 1, 1, 1, "n"), (None, None, None, None, None, None, None, None), (200, None, "en", "w", 0, 0, 0, ""), (201, "", "en", "w", 0, 0, 0, ""), (202, "12 34 !", "en", "w", 7, 0, 0, "")]
    rows += [(300, " ".join(WORDS) * 3000, "en", "web0", 1, 1, 1, "long")]
    return rows


@pytest.mark.parametrize("rows, kept", [(odd_documents(), None), ([], 0), ([(1, "a single short text of some words", "en", "web0", 1, 1, 1, "r")], 1), ([(None, "a text without an id here", "en", "w", 1, 1, 1, "r")], 0)])
def test_odd_tables(spark, tmp_path, rows, kept):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, None), (2, ""), (3, rows[20][1] if len(rows) > 20 else "nothing like it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after.append(docs.collect())
        if name != "token_files":
            assert docs.columns == [c.name for c in spark.read.parquet(str(tmp_path / "documents.parquet")).schema]
    if kept is not None:
        assert len(after[0]) == (0 if kept == 0 else len(after[0])) and len(after[-1]) <= len(rows)
        return
    told = [[r["doc_id"] for r in x] for x in after]
    assert not {200, 201, 202} & set(told[0]) and told[0].count(None) == 1 and told[0].count(5) == 2 and 300 in told[0]
    assert not {100, 101, 102} & set(told[1]) and told[1].count(5) == 1 == told[1].count(6) and set(range(30)) - {9} <= set(told[1]) and None in told[1]
    assert 9 not in told[1]  # a near copy of one of id 6's texts
    assert [r["text"] for r in after[1] if r["doc_id"] == 6] == [min(r[1] for r in rows if r[0] == 6)]
    assert 20 not in told[2] and set(told[2]) == set(told[1]) - {20}
    assert set(told[3]) <= set(told[2]) and sorted(told[4], key=str) == sorted(told[3], key=str)
