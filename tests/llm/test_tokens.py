"""Operators 1 and 2: the library's ids, and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fourfold.llm import packing
from fourfold.llm.encoders import RunEncoder, load, public_path, safe_cuts
from fourfold.llm.token_counts import count_tokens
from fourfold.llm.token_files import read_token_files, token_files, write_token_files

WORD = public_path("word_bpe_49k.json")
HARD = [
    "", " ", "a<|endoftext|>b c <|startoftext|>", "<|ENDOFTEXT|>", "don't I'll 's x's", "\x1c.\x1c a\x85b\xa0c", "É é ΑΣ ΑΣ. İstanbul ß ﬁ 漢字 カタカナ 😀👍🏽",
    "a b　c\tz\r\n\x0b\x0c", "x" * 3000, "123 4a5 a.b,c d.. e., ...", "a" + "́" + " ́b", "word. Word, WORD.", "ª º µ ÷×",
]
TABLE = [(3, "b a. b", "x"), (1, None, None), (2, "", "y"), (2, "a<|endoftext|>", "z"), (None, "no id", "z"), (7, "long words " * 30_000, ""), (3, "b a. b", "x")]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(WORD)
    return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)]


def test_runs_give_the_librarys_ids(library):
    rng = random.Random(0)
    letters = "aB.,'é́ \n\t\x1c\xa0sTdl<|>1²ªßÀ漢Σ!$#-_"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encoder = load(WORD)
    assert isinstance(encoder, RunEncoder)
    assert [x.tolist() for x in encoder.ids(texts)] == library(texts)
    assert encoder.lengths(texts) == [len(x) for x in library(texts)]
    assert encoder.ids([]) == []


def test_runs_known_from_before_and_marks(library):
    """A word that was learned as a run of its own serves runs with capitals and marks; marks stand for themselves."""
    texts = ["word été", "Word, WORD!! word$$$ word-- Été... été's été' l'été", "###!! ' 's word'", "word<|endoftext|>, x<| |>x"]
    for order in (texts, texts[::-1]):
        encoder = load(WORD)
        for text in order:
            assert encoder.ids([text])[0].tolist() == library([text])[0]


def test_runs_survive_forgetting(library, monkeypatch):
    monkeypatch.setattr("fourfold.llm.encoders.REMEMBERED", 3)
    encoder = load(WORD)
    for text in HARD * 2:
        assert encoder.ids([text])[0].tolist() == library([text])[0]


def test_other_vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["", "Some plain words, and more. " * 9, "a <|endoftext|> b"]
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in load(public_path("byte_bpe_50k.json")).ids(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    assert [x.tolist() for x in load(public_path("piece_bpe_32k.model")).ids(texts)] == pieces.encode(texts, num_threads=1)


def test_cuts_keep_the_ids_of_byte_level_texts():
    from tokenizers import Tokenizer

    from fourfold.llm.encoders import BEFORE_WORD

    text = "Plain words and 12 numbers, marks -- and  two spaces\n\n" * 40
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    cut = safe_cuts(text, 100, BEFORE_WORD)
    assert len(cut) > 9 and "".join(cut) == text
    assert sum((plain.encode(x, add_special_tokens=False).ids for x in cut), []) == plain.encode(text, add_special_tokens=False).ids


def test_counts(spark, library):
    found = count_tokens(spark.createDataFrame(TABLE, SCHEMA), WORD, limit=2048).collect()
    told = [(i, len((t or "").encode()), len(library([t or ""])[0])) for i, t, _ in TABLE]
    assert sorted(map(tuple, found), key=str) == sorted(((*x, x[2] > 2048) for x in told), key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA), WORD).count() == 0


documents = st.lists(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700).map(lambda x: np.array(x, np.uint32)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(documents)
def test_packing_round_trip(found):
    assert [x.tolist() for x in packing.decode(packing.encode(found))] == [x.tolist() for x in found]


def test_packing_uses_exceptions():
    ids = np.array([5, 6, 7, 8] * 64, np.uint32)
    ids[17] = 2**31
    data = packing.encode([ids])[0]
    assert len(data) < 12 + packing.HEAD + 64 + 5 + 1
    assert packing.decode([data])[0].tolist() == ids.tolist()


def test_files(spark, library):
    rows = token_files(spark.createDataFrame(TABLE, SCHEMA).repartition(3), WORD).collect()
    texts = sorted(((i, t or "") for i, t, _ in TABLE), key=lambda x: (x[0] is not None, x[0] or 0))
    told, start = [], 0
    for (i, _), ids in zip(texts, library([t for _, t in texts])):
        ids = np.array([*ids, 2], "<u4")
        told.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    by_start = sorted((tuple(r) for r in rows), key=lambda x: x[1])
    assert [x[0] for x in by_start] == [x[0] for x in told]
    assert sorted(x[2:] for x in by_start) == sorted(x[2:] for x in told)
    single = [i for i, _ in texts if [x[0] for x in told].count(i) == 1]
    assert [x for x in by_start if x[0] in single] == [x for x in told if x[0] in single]


def test_files_hold_the_ids_in_order(spark, library, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    write_token_files(docs, WORD, str(tmp_path / "out"))
    rows = sorted(read_token_files(spark, str(tmp_path / "out")).collect(), key=lambda r: r["start"])
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert [r["ids"] for r in rows] == [[*x, 2] for x in library([t for _, t in texts])]
    stored = spark.read.parquet(str(tmp_path / "out")).orderBy("file", "segment").collect()
    assert len({r["file"] for r in stored}) > 1


def test_no_documents(spark):
    assert token_files(spark.createDataFrame([], SCHEMA), WORD).count() == 0
