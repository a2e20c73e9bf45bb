"""Operator 8: language identification of spans.

A run between white space is cut into words at what is no letter, at changes of script, and after PIECE letters if it is
longer than LONG. A word's script narrows the languages to those that write in it. Each distinct run's words are scored once
per language by the likelihood of their character n-grams; Viterbi over a text's words with a penalty for each switch of
language labels its spans.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import mapped, slices, text_of

#: First code points of scripts' ranges, in order; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
FIRSTS = [first for first, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS})
LATIN = NAMES.index("latin")
#: Buckets of n-grams, and the longest n-gram.
BITS, LONGEST = 16, 4
BUCKETS = 1 << BITS
#: A fixed odd number near 2**64 over the golden ratio, which spreads what it multiplies.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Labelled rows of each language that the scores are learned from: about so many, each drawn for itself by a seeded hash of its
#: id and text. Languages at most, as the model holds BUCKETS numbers of each.
ROWS, MOST_LANGUAGES = 3000, 1000
#: A language that writes less than this share of its words in a script is no candidate for it.
USES = 0.01
#: Nats: the most that a word speaks against a language, its weight, and the price of a switch.
CLIP, WEIGHT, SWITCH = 6.0, 0.5, 8.0
#: Distinct runs that a worker remembers, and words that it scores at once.
REMEMBERED, AT_ONCE = 400_000, 40_000
#: Letters of a word that is not cut, and of the pieces of a longer one.
LONG, PIECE = 60, 20
#: What joins the letters of a word: apostrophes, the soft hyphen and the joiners of some scripts.
JOINS = frozenset("'\u2019\u02bc\u00ad\u200c\u200d")
UNKNOWN = "und"


def script(word: str) -> int:
    """The number in NAMES of the script of the word's first letter; -1 if it has none."""
    for c in word:
        if c.isalpha():
            return LATIN if c < "\u0370" else NAMES.index(SCRIPTS[bisect_right(FIRSTS, ord(c)) - 1][1])
    return -1


def pieces(run: str) -> list[tuple[str, int]]:
    """The words of a run, their letters in lower case, and how many characters of the run are before each (0 for the first);
    one empty word if there is no letter. Marks belong to their word."""
    if run.isascii() and run.isalpha() and len(run) <= LONG:
        return [(run.lower(), 0)]
    found: list[tuple[str, int]] = []
    word, of = "", -1

    def close():
        step = PIECE if len(word) > LONG else LONG
        found.extend((word[k : k + step], places[k]) for k in range(0, len(word), step))

    places: list[int] = []
    for at, shown in enumerate(run):
        if not shown.isalpha():
            if word and shown not in JOINS and not unicodedata.category(shown).startswith("M"):
                close()
                word, places = "", []
            continue
        for c in shown.lower():
            if not c.isalpha():
                continue
            if word and script(c) != of:
                close()
                word, places = "", []
            if not word:
                of = script(c)
            word += c
            places.append(at)
    if word:
        close()
    return [(found[0][0], 0), *found[1:]] if found else [("", 0)]


def grams(words: list[str]):
    """Buckets of all words' n-grams between bounds, for each n: the bucket of each place, and whether the n-gram ends in its
    word; and the first place of each word."""
    held = [f"^{w}$".encode() for w in words]
    data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    found, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, LONGEST + 1):
        code[: len(data) - n + 1] |= data[n - 1 :] << np.uint64(8 * (n - 1))
        found.append(((code + np.uint64(n << 40)) * SPREAD >> np.uint64(64 - BITS), left >= n))
    whole = np.fromiter((zlib.crc32(w) for w in held), np.uint64, len(held))
    at_start = np.zeros(len(data), bool)
    at_start[ends - sizes] = True
    spread = np.zeros(len(data), np.uint64)
    spread[ends - sizes] = whole * SPREAD >> np.uint64(64 - BITS)
    return [*found, (spread, at_start)], ends - sizes


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # log-likelihoods: BUCKETS x languages
    writes: np.ndarray  # scripts x languages: is it a candidate?

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word of pieces(), 0 for the likeliest language, and its letters: all, and 0 if no language writes them."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        size = np.zeros((len(words), 2), np.int32)
        at, kept = [], []
        for k, word in enumerate(words):
            size[k, 0] = len(word)
            if word:
                at.append(k)
                kept.append(word)
        if not kept:
            return out, size
        found, first = grams(kept)
        sums = np.zeros((len(kept), len(self.languages)), np.float32)
        for bucket, valid in found:
            sums += np.add.reduceat(np.where(valid[:, None], self.scores[bucket], np.float32(0)), first, axis=0)
        sums *= WEIGHT
        scripts = np.fromiter(map(script, kept), np.int64, len(kept))
        may = self.writes[scripts]
        best = np.where(may, sums, -np.inf).max(axis=1, keepdims=True)
        narrowed = np.where(may, np.maximum(sums - best, -CLIP), -CLIP)
        out[at] = np.where(may.any(axis=1)[:, None], narrowed, 0)
        size[at, 1] = np.where(may.any(axis=1), size[at, 0], 0)
        return out, size


def learn(rows: DataFrame) -> Model | None:
    """The model of rows (text, lang and, if there are ids, doc_id), lang not null; None if there are none.

    About ROWS rows of each language are read; more than MOST_LANGUAGES languages raise. Their n-grams are counted where they are and summed up; BUCKETS numbers of
    each language reach the driver.
    """
    held = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not held:
        return None
    if len(held) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    some = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, ROWS / n))) for lang, n in held.items()))
    draw = F.pmod(F.xxhash64(F.lit(8), *(c for c in ("doc_id", "text") if c in rows.columns)), F.lit(1 << 20)) / (1 << 20)
    drawn = rows.where(draw < some).select("lang", "text")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1):
                seen: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen.setdefault(lang, Counter()).update(text.split())
                for lang, of_runs in seen.items():
                    of_words: Counter = Counter()
                    for run, n in of_runs.items():
                        for word, _ in pieces(run):
                            of_words[word] += n
                    of_words.pop("", None)
                    if not of_words:
                        continue
                    words, weight = list(of_words), np.fromiter(of_words.values(), np.int64, len(of_words))
                    found, first = grams(words)
                    each = np.repeat(weight, np.diff([*first.tolist(), len(found[0][0])]))
                    mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for bucket, valid in found:
                        mine += np.bincount(bucket[valid].astype(np.int64), each[valid], BUCKETS).astype(np.int64)
                    of_script = np.fromiter(map(script, words), np.int64, len(words))
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(of_script, weight, len(NAMES)).astype(np.int64)
        for lang, mine in counts.items():
            both = np.concatenate([mine, scripts.get(lang, np.zeros(len(NAMES), np.int64))])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = mapped(drawn, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    languages = sorted(held)
    at = np.array([languages.index(x) for x in found.column("lang").to_pylist()], np.int64)
    table = np.zeros((BUCKETS + len(NAMES), len(languages)))
    if len(at):
        table[found.column("bucket").to_numpy(), at] = found.column("n").to_numpy()
    counts, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    writes = scripts >= USES * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), writes & (scripts > 0))


class Scorer:
    """Scores of the words of runs between white space, each distinct run's scored once."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.first = np.zeros(1, np.int64)  # of each known run: its first word; then the number of words
        self.scores, self.sizes = model.of_words([])

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: the numbers of its words, and their letters."""
        if len(self.sizes) > REMEMBERED:
            self.__init__(self.model)
        known, fresh, out = self.known, [], []
        for text in texts:
            runs = text.split()
            at = np.fromiter((known.get(r, -1) for r in runs), np.int64, len(runs))
            for k in np.flatnonzero(at < 0).tolist():
                before = len(known)
                at[k] = known.setdefault(runs[k], before)
                if at[k] == before:
                    fresh.append(runs[k])
            out.append(at)
        if fresh:
            words = [[w for w, _ in pieces(run)] for run in fresh]
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in words])])
            flat = [w for x in words for w in x]
            found = [self.model.of_words(flat[k : k + AT_ONCE]) for k in range(0, len(flat), AT_ONCE)]
            self.scores = np.concatenate([self.scores, *(x for x, _ in found)])
            self.sizes = np.concatenate([self.sizes, *(x for _, x in found)])
        out = [self.words_at(at) for at in out]
        return [(at, self.sizes[at]) for at in out]

    def words_at(self, runs: np.ndarray) -> np.ndarray:
        first, count = self.first[runs], self.first[runs + 1] - self.first[runs]
        if (count == 1).all():
            return first
        return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def constant(total: np.ndarray, scores: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which texts are best labelled with one language alone, the one of the largest total.

    A labelling by m stretches of other languages has m switches if the one language is in it, else m - 1, and m is 2 at
    least, as that language has the largest total. If no stretch gains more than half a switch over it, none beats it.
    `owner` has the text of each word, `first` where texts begin.
    """
    top = total.argmax(axis=1)
    fine = np.ones(len(total), bool)
    apart = owner * 1e7
    for k in range(scores.shape[1]):
        gain = np.cumsum(scores[:, k].astype(np.float64) - scores[np.arange(len(scores)), top[owner]])
        before = np.concatenate([[0.0], gain[:-1]])
        low = np.minimum.accumulate(before - apart) + apart
        fine &= np.maximum.reduceat(gain - low, first) <= SWITCH / 2
    return fine


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each text's words; all texts step together, longest first."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    n, count = len(order), scores[0].shape[1]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts longer than the step
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate([scores[k] for k in order]).astype(np.float64)
    value = np.zeros((n, count))
    switched = np.zeros((len(flat), count), bool)
    source = np.zeros(len(flat), np.int16)
    for t in range(longest):
        m = int(active[t])
        at = starts[:m] + t
        if t:
            best = value[:m].argmax(axis=1)
            jump = value[np.arange(m), best][:, None] - SWITCH
            switched[at] = jump > value[:m]
            source[at] = best
            value[:m] = np.maximum(value[:m], jump)
        value[:m] += flat[at]
    label = np.zeros(len(flat), np.int16)
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = int(active[t])
        at = starts[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(switched[at, now[:m]], source[at], now[:m])
    out: list = [None] * n
    for k, s, length in zip(order, starts.tolist(), lengths.tolist()):
        out[k] = label[s : s + length]
    return out


def labels(scorer: Scorer, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: a language per word, the words' letters (all, and those that some language writes), and the words' scores'
    numbers."""
    runs = scorer(texts)
    full = [k for k, (at, _) in enumerate(runs) if len(at)]
    out = [(np.empty(0, np.int16), np.empty((0, 2), np.int32), np.empty(0, np.int64))] * len(texts)
    if not full:
        return out
    sizes = np.array([len(runs[k][0]) for k in full])
    first = np.cumsum(sizes) - sizes
    scores = scorer.scores[np.concatenate([runs[k][0] for k in full])]
    owner = np.repeat(np.arange(len(full)), sizes)
    total = np.add.reduceat(scores.astype(np.float64), first, axis=0)
    fine = constant(total, scores, owner, first)
    rest = np.flatnonzero(~fine)
    mixed = viterbi([scores[first[k] : first[k] + sizes[k]] for k in rest]) if len(rest) else []
    by = dict(zip(rest.tolist(), mixed))
    for k, doc in enumerate(full):
        label = by.get(k)
        out[doc] = (np.full(sizes[k], total[k].argmax(), np.int16) if label is None else label, runs[doc][1], runs[doc][0])
    return out


def judged(scorer: Scorer, texts: list[str]) -> list[tuple[str, float, list]]:
    """Of each text: the language with most letters, a score, and the spans (first word, word after the last, language).

    The score is the share of the letters that this language has in scripts of some language, times how sure its words are
    of it against the runner-up.
    """
    languages, out = scorer.model.languages, []
    for label, size, at in labels(scorer, texts):
        letters = int(size[:, 0].sum())
        if not letters:
            out.append((UNKNOWN, 0.0, []))
            continue
        by = np.bincount(label, size[:, 0], len(languages))
        top = int(by.argmax())
        written = int(size[label == top, 1].sum())
        sums = scorer.scores[at[label == top]].sum(axis=0, dtype=np.float64)
        rival = np.delete(sums, top).max() if len(languages) > 1 else -math.inf
        sure = 1 - math.exp(min(0.0, rival - sums[top]) / 4)
        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        spans = [(a, b, languages[label[a]]) for a, b in zip(cuts, cuts[1:])]
        out.append((languages[top], float(written / letters * sure), spans))
    return out


def in_runs(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Spans of words as spans of runs between white space, and the characters of the text that they begin and end at.

    A run in which the language changes belongs to the later span, whose `begin` lies inside it.
    """
    if not spans:
        return []
    starts, place = [], 0
    for k, run in enumerate(text.split()):
        place = text.index(run, place)
        starts += [(k, place + inside) for _, inside in pieces(run)]
        place += len(run)
    starts.append((k + 1, place))
    return [{"first": starts[a][0], "after": starts[b][0], "lang": lang, "begin": starts[a][1], "end": starts[b][1]} for a, b, lang in spans]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out and have a language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    return learn(rows.select("doc_id", text_of().alias("text"), F.col("lang").cast("string").alias("lang")))


def languages(docs: DataFrame, model: Model | None = None, with_spans: bool = False) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id's text mod 4 is 2), lang_pred, score, and spans if asked for.

    The model is learned from the rows that are not held out and have an id and a lang, unless given. Null texts and those
    without a letter, and all texts if nothing could be learned, are `und` with score 0. Equally likely languages tie for the
    first by name. Texts whose script no language
    writes get the first language with score 0. Whole texts are labelled. Rows that share an id keep a row each; an empty
    table gives an empty result; other columns are not read.
    """
    model = model or learned(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def predict(batches):
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                found = judged(scorer, texts) if scorer else [(UNKNOWN, 0.0, [])] * len(texts)
                columns = [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                spans = [in_runs(text, x[2]) for text, x in zip(texts, found)] if with_spans else []
                kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
                more = [pa.array(spans, kind)] if with_spans else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "lang_pred", "score", *["spans"] * with_spans])

    out = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,after:int,lang:string,begin:int,end:int>>" * with_spans
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = mapped(read, predict, out)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *found.columns[1:])


def with_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """`docs`, whole rows, without those that have no letter or no language with a score of `least`.

    The model is learned from rows of `docs` as in `languages`; if nothing can be learned, as in an empty table or one without
    a lang, no row stays. Null texts go. Rows are judged one by one, so repeated rows, repeated and null ids all keep what is
    theirs; equally likely languages tie for the first by name. Other columns may be called anything.
    """
    model = learned(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema, place = docs.schema, docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for part in slices(batch, place):
                texts = [x or "" for x in part.column(place).to_pylist()]
                found = judged(scorer, texts) if scorer else [(UNKNOWN, 0.0, [])] * len(texts)
                yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in found], pa.bool_()))

    return mapped(docs, keep, schema)
