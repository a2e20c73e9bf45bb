"""Exact token ids of whole texts, with repeated words encoded once.

A `.json` vocabulary whose pre-tokenizer drops white space treats each run between ASCII spaces and line ends alone:
normalization composes nothing across a space, every match of the split pattern ends there, and the added tokens hold
none. Such texts are cut there, every distinct run is encoded once, and the runs' ids are joined. Other vocabularies get
the library's batch encoding on whole texts, cut only where `safe_cuts` shows that a cut changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import string
from itertools import chain

import numpy as np

#: Distinct runs that a worker remembers before it starts anew, at about 150 bytes each.
REMEMBERED = 800_000
#: Letters that normalization leaves composed and lower-cases one to one.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: ASCII marks: what follows the letters of a run is one match of the split pattern if it has nothing else.
MARKS = string.punctuation


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class Remember(dict):
    """run -> its number, in order of first sight; new runs wait in `fresh`."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, run):
        self[run] = number = len(self)
        self.fresh.append(run)
        return number


class RunEncoder:
    """Encodes texts by their distinct runs."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.reset()

    def reset(self):
        self.runs = Remember()
        self.flat, self.start, self.size = np.empty(1 << 16, np.uint16), np.zeros(1, np.int64), np.empty(0, np.int32)

    def of_word(self, word: str) -> list[int]:
        """Ids of one lower-case word or mark; `word` needs no normalization and is one match of the split pattern."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def learn(self):
        """Ids of the runs that are new."""
        fresh, self.runs.fresh = self.runs.fresh, []
        if not fresh:
            return
        marks, words, odd, ids = {}, {}, [], [None] * len(fresh)
        learned, number = len(self.size), self.runs.get
        for k, run in enumerate(fresh):
            shown = run.rstrip(MARKS)
            if shown.isalpha() and (shown.isascii() or PLAIN(shown)):
                word = shown.lower()
                found = words.get(word)
                if found is None:
                    n = number(word, learned)
                    found = words[word] = self.flat[self.start[n] : self.start[n + 1]].tolist() if n < learned else self.of_word(word)
                if len(shown) < len(run):
                    mark = run[len(shown) :]
                    if mark not in marks:
                        marks[mark] = self.of_word(mark)
                    found = found + marks[mark]
                ids[k] = found
            elif run:
                odd.append(k)
            else:
                ids[k] = []
        for k, found in zip(odd, self.tokenizer.encode_batch_fast([fresh[k] for k in odd], add_special_tokens=False)):
            ids[k] = found.ids
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        used = int(self.start[-1])
        need = used + int(sizes.sum())
        new = np.fromiter(chain.from_iterable(ids), np.uint32, need - used)
        kind = np.uint32 if len(new) and new.max() > 65535 else self.flat.dtype
        if need > len(self.flat) or kind != self.flat.dtype:
            grown = np.empty(max(need, 2 * len(self.flat)), kind)
            grown[:used] = self.flat[:used]
            self.flat = grown
        self.flat[used:need] = new
        self.size = np.concatenate([self.size, sizes])
        self.start = np.concatenate([self.start, used + np.cumsum(sizes)])

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the numbers of its runs; `learn` has them."""
        if len(self.runs) > REMEMBERED:
            self.reset()
        known, out = self.runs.__getitem__, []
        for text in texts:
            runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(np.fromiter(map(known, runs), np.int32, len(runs)))
        self.learn()
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        return [int(self.size[n].sum()) for n in self.numbers(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        numbers = self.numbers(texts)
        runs = np.concatenate(numbers)
        sizes = self.size[runs]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.start[runs] - ends + sizes, sizes)
        at += np.arange(len(at))
        last = np.cumsum([len(n) for n in numbers]) - 1  # a text has one run at least
        return np.split(self.flat[at], ends[last[:-1]])


class WholeEncoder:
    """The library's own batch encoding."""

    def __init__(self, encode, longest: int = 1 << 16, cut=None):
        self.encode, self.longest, self.cut = encode, longest, cut

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        pieces, owner = [], []
        for k, text in enumerate(texts):
            parts = safe_cuts(text, self.longest, self.cut) if self.cut else [text]
            pieces += parts
            owner += [k] * len(parts)
        out = [[] for _ in texts]
        for k, found in zip(owner, self.encode(pieces)):
            out[k].append(np.asarray(found, np.uint32))
        return [np.concatenate(x) if x else np.empty(0, np.uint32) for x in out]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.ids(texts)]


def safe_cuts(text: str, longest: int, pattern: re.Pattern) -> list[str]:
    """`text` in pieces of about `longest` characters, cut at matches of `pattern` only; whole if there are none."""
    out, at = [], 0
    while len(text) - at > longest and (found := pattern.search(text, at + longest)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


#: A space between two ASCII letters starts a new match of the byte-level split pattern.
BEFORE_WORD = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
_kept: dict[str, RunEncoder | WholeEncoder] = {}


def encoder(path: str) -> RunEncoder | WholeEncoder:
    """The encoder of the file, kept for as long as the worker lives."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = load(path)
    return _kept[path]


def forget() -> None:
    _kept.clear()


def load(path: str) -> RunEncoder | WholeEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeEncoder(lambda texts: model.encode(texts, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if by_runs(spec):
        return RunEncoder(tokenizer)
    steps = json.dumps(spec.get("pre_tokenizer") or {})
    byte_level = '"ByteLevel"' in steps and '"Split"' not in steps and spec.get("normalizer") is None
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return WholeEncoder(encode, cut=BEFORE_WORD if byte_level else None)


def by_runs(spec: dict) -> bool:
    """Does the file drop white space, compose, lower-case and keep runs of letters as `RunEncoder` takes it to?"""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    split = steps[0]
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"[\p{L}]+" in split.get("pattern", {}).get("Regex", "")
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("add_prefix_space")
        and norms == ["NFC", "Replace", "Lowercase"]
        and spec["model"]["type"] == "BPE"
        and not any(re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    )
