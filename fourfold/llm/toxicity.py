"""Operator 9: toxicity by compression distance.

Words are coded as hashes of equal length, so that Zstandard matches whole words and nothing else. Two dictionaries are
trained by Zstandard, one on toxic and one on ordinary texts, each on windows of the words that its kind uses surely more
often; both stand behind a part trained on plain ordinary windows, so that common words cost the same with either. A window
of words that compresses better with the toxic one holds such words. A text's gains over its windows are summed, and a
logistic curve turns the sum into a score. The curve, and how sure a word must be, are fitted on a fourth of the learning
texts with dictionaries that have not seen them; then the dictionaries are trained on all learning texts. Nothing is learned
from rows that are held out.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import checkpointed, mapped, slices, text_of

#: Labelled rows of each kind that the model is fitted on: about so many, chosen by a seeded hash.
TOXIC_ROWS, ORDINARY_ROWS = 4000, 12_000
#: A word is left in the windows of its kind if SUPPORT of its documents have it, FEW at least, and the log of its odds is
#: over LEAN and over one of SURE standard errors; the one that fits the calibration texts best. MOST_WORDS such words at
#: most, the surest.
MOST_WORDS, SUPPORT, FEW, LEAN, SURE = 8000, 0.01, 4, 2.0, (2.2, 2.6, 3.2)
#: Bytes of a word's code, words of a window, bytes of the dictionaries' common and own parts, windows that each is trained on.
CODE, WINDOW, SHARED, OWN, SAMPLES = 12, 16, 32_768, 98_304, 20_000
#: A window's gain counts from here on, and a text's sum to there.
NOISE, MOST_GAIN = 1, 40
REMEMBERED = 400_000
WORD = re.compile(r"[^\s.,;:!?|]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Codes(dict):
    """word -> its code."""

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = code = hashlib.blake2b(word.encode(), digest_size=CODE).digest()
        return code


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    slope: float
    offset: float

    def score(self, gains: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(gains, MOST_GAIN) + self.offset, -50, 50)))


class Gains:
    """The summed gains of texts."""

    def __init__(self, model: Model):
        self.codes = Codes()
        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)

    def __call__(self, texts: list[str]) -> np.ndarray:
        windows, owner, codes = [], [], self.codes.__getitem__
        for k, text in enumerate(texts):
            coded = list(map(codes, words_of(text)))
            for first in range(0, len(coded), WINDOW):
                windows.append(b"".join(coded[first : first + WINDOW]))
                owner.append(k)
        if not windows:
            return np.zeros(len(texts))
        gain = lengths(self.ordinary, windows) - lengths(self.toxic, windows)
        return np.bincount(np.array(owner), np.maximum(gain - NOISE, 0), len(texts))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Hash chains keep every place of the dictionary, so that two dictionaries differ in what differs alone."""
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    settings = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=6, target_length=0, strategy=zstandard.STRATEGY_GREEDY, **plain)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=held)


def lengths(by: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """Compressed lengths, in one call without the interpreter between windows."""
    size = np.fromiter(map(len, windows), "<u8", len(windows))
    places = np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8")
    found = by.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), places.tobytes()), threads=1)
    return np.fromiter(map(len, found), np.int64, len(windows))


def trained(samples: list[bytes], size: int) -> bytes:
    """What the library's training picks of the samples; the samples themselves if they are too few for it."""
    whole = b"".join(samples)
    if len(whole) <= size:
        return whole
    try:
        return zstandard.train_dictionary(size, samples, k=4 * CODE, d=8, f=20, accel=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def whole_codes(content: bytes, known: set[bytes]) -> bytes:
    """The known codes in a dictionary, each once, where the training put it last. Cut and repeated codes only lead the
    search for matches astray."""
    found, at = {}, 0
    while at <= len(content) - CODE:
        code = content[at : at + CODE]
        if code in known:
            found.pop(code, None)
            found[code] = None
            at += CODE
        else:
            at += 1
    return b"".join(found)


def sketch(words: list[str]) -> list[int]:
    """Three minima of hashes of five words; copies share one."""
    grams = [hash_of(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))]
    return [min(g * m % (1 << 61) for g in grams) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def unlike(rows: list) -> dict[int, tuple[float, bool]]:
    """doc_id -> (toxic, is it for calibration?) of rows that share no minimum with an earlier one; every fourth of a kind
    is for calibration."""
    seen, out, count = set(), {}, {0: 0, 1: 0}
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        mine = set(enumerate(row["minima"]))
        if not seen & mine and row["doc_id"] not in out:
            out[row["doc_id"]] = (row["toxic"], count[row["toxic"]] % 4 == 3)
            count[row["toxic"]] += 1
        seen |= mine
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of about TOXIC_ROWS and ORDINARY_ROWS labelled documents, an id once, and how many each stands
    for."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {1: min(1.0, TOXIC_ROWS / max(1, count.get(1, 0))), 0: min(1.0, ORDINARY_ROWS / max(1, count.get(0, 0)))}
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    drawn = known.where(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])).select(F.col("doc_id").alias("of_id"), "toxic")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = read.join(F.broadcast(drawn), F.col("doc_id") == F.col("of_id"))  # the sample's size at most
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), {k: 1 / r for k, r in rate.items()}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents that are not held out. Only samples of bounded size reach the driver."""
    spark = docs.sparkSession
    rows, stands = sampled(docs, labels)
    rows = checkpointed(rows)

    def sketches(batches):
        for batch in batches:
            for part in slices(batch, 1):
                minima = [sketch(words_of(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(minima, pa.list_(pa.int64()))], names=["doc_id", "toxic", "minima"])

    chosen = unlike(mapped(rows, sketches, "doc_id long, toxic int, minima array<long>").collect())
    total = [sum(1 for t, cal in chosen.values() if t == kind and not cal) for kind in (0, 1)]
    if not all(total):
        rate = sum(t * stands[t] for t, _ in chosen.values()) / max(1e-9, sum(stands[t] for t, _ in chosen.values())) if chosen else 0.0
        return Model(b"", b"", 0.0, math.log((rate + 1e-6) / (1 - rate + 1e-6)))
    told = spark.sparkContext.broadcast(chosen)

    def learnt(batches):
        """(id, text, toxic, is it for calibration?) of the chosen documents."""
        for batch in batches:
            for part in slices(batch, 1):
                for i, text, t in zip(*(c.to_pylist() for c in part.columns)):
                    if i in told.value:
                        yield i, text, t, told.value[i][1]

    def frequencies(batches):
        counts: dict[str, list[int]] = {}
        for _, text, t, cal in learnt(batches):
            for word in set(words_of(text)):
                counts.setdefault(word, [0, 0, 0, 0])[t + 2 * cal] += 1
        columns = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *columns], names=["word", *(f"n{k}" for k in range(4))])

    found = mapped(rows, frequencies, "word string, n0 long, n1 long, n2 long, n3 long").groupBy("word").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    found = checkpointed(found.where(f"n0 + n2 >= {FEW} or n1 + n3 >= {FEW}"))
    whole = [sum(1 for t, _ in chosen.values() if t == kind) for kind in (0, 1)]
    sure = [leaning(found.select("word", F.col("n0").alias("ordinary"), F.col("n1").alias("toxic")), total)]
    sure.append(leaning(found.select("word", (F.col("n0") + F.col("n2")).alias("ordinary"), (F.col("n1") + F.col("n3")).alias("toxic")), whole))
    told_sure = spark.sparkContext.broadcast([set(a) | set(b) for a, b in zip(*sure)])  # 2 x MOST_WORDS words of each kind at most

    def coded(batches):
        """Windows of words: kind 0 and 1 of the words that lean to a kind, 2 of all words of ordinary texts."""
        codes, kinds = Codes(), (pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        for i, text, t, cal in learnt(batches):
            words = words_of(text)
            each = [(t, [w for w in words if w in told_sure.value[t]]), *[(2, words)] * (not t and not cal)]
            out = [(kind, hash_of(f"{i} {kind} {k}") >> 1, b"".join(codes[w] for w in some[k : k + 32]), cal) for kind, some in each for k in range(0, len(some), 32)]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], kind) for n, kind in enumerate(kinds)], names=["kind", "draw", "window", "cal"])

    windows = checkpointed(mapped(rows, coded, "kind int, draw long, window binary, cal boolean"))
    draw = lambda which: [bytes(r["window"]) for r in windows.where(which).orderBy("draw", "window").limit(SAMPLES).collect()]
    base = trained(draw("kind = 2"), SHARED)
    apart, all_ = ([draw(f"kind = {kind} and {which}") for kind in (0, 1)] for which in ("not cal", "true"))
    surer = lambda words, least: [{w for w, s in x.items() if s > least} for x in words]
    settings = [dictionaries(base, apart, surer(sure[0], least)) for least in SURE]

    def gains(batches):
        by = [Gains(Model(*x, 0.0, 0.0)) for x in settings]
        for batch in batches:
            held = [(text, t) for _, text, t, cal in learnt([batch]) if cal]
            found = [g([text for text, _ in held]) for g in by]
            row = [pa.array([t for _, t in held], pa.int32()), *(pa.array(x, pa.float64()) for x in found)]
            yield pa.RecordBatch.from_arrays(row, names=["toxic", *(f"gain_{k}" for k in range(len(by)))])

    told_gains = mapped(rows, gains, "toxic int" + "".join(f", gain_{k} double" for k in range(len(settings)))).collect()
    fits = [logistic([(r[f"gain_{k}"], r["toxic"], stands[r["toxic"]]) for r in told_gains]) for k in range(len(settings))]
    best = min(range(len(settings)), key=lambda k: (fits[k][2], k))
    return Model(*dictionaries(base, all_, surer(sure[1], SURE[best])), *fits[best][:2])


def leaning(found: DataFrame, total: list[int]) -> list[dict[str, float]]:
    """Of each kind (0 ordinary, 1 toxic) the words that lean to it, and how many standard errors the log of their odds is."""
    out = []
    for mine, theirs, n, m in (("ordinary", "toxic", *total), ("toxic", "ordinary", *reversed(total))):
        lean = F.log((F.col(mine) + 0.5) / (n + 1) / ((F.col(theirs) + 0.5) / (m + 1)))
        sure = lean / F.sqrt(1 / (F.col(mine) + 0.5) + 1 / (F.col(theirs) + 0.5))
        some = found.where(F.col(mine) >= max(FEW, SUPPORT * n)).select("word", lean.alias("lean"), sure.alias("sure")).where((F.col("lean") > LEAN) & (F.col("sure") > min(SURE)))
        out.append({r["word"]: r["sure"] for r in some.orderBy(F.desc("sure"), "word").limit(MOST_WORDS).collect()})
    return out


def dictionaries(base: bytes, windows: list[list[bytes]], words: list[set[str]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: `base`, then what training picks of each kind's windows of these words, filled
    up to one length."""
    codes, ends = Codes(), []
    for some, of_kind in zip(windows, words):
        known = {codes[w] for w in of_kind}
        kept = [b"".join(c for c in (w[k : k + CODE] for k in range(0, len(w), CODE)) if c in known) for w in some]
        ends.append(whole_codes(trained([w for w in kept if w], OWN), known))
    size = max(map(len, ends))
    ordinary, toxic = (base + filler(size - len(e)) + e for e in ends)
    return toxic, ordinary


def filler(size: int) -> bytes:
    """Bytes that match no code."""
    return b"".join(hashlib.blake2b(b"filler %d" % k, digest_size=64).digest() for k in range(size // 64 + 1))[:size]


def logistic(rows: list[tuple[float, int, float]]) -> tuple[float, float, float]:
    """Slope, offset and loss of rows (gain, toxic, weight) by Newton's steps, with a slight pull to 0.2 a byte."""
    if not rows:
        return 0.4, -3.0, 0.0
    x, y, w = (np.array(v, float) for v in zip(*rows))
    design = np.stack([np.minimum(x, MOST_GAIN), np.ones(len(x))], axis=1)
    start = np.array([0.4, -3.0])
    theta, pull = start.copy(), np.diag([4.0, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (w * (y - p)) - pull @ (theta - start)
        bend = (design * (w * p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(bend, slope)
        theta = theta + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    theta[0] = max(theta[0], 0.0)
    p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
    return float(theta[0]), float(theta[1]), float(-(w * np.log(np.where(y == 1, p, 1 - p))).sum())


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id's text mod 3 is 1), score (0 to 1), predicted (1 if score >= `least`).

    The model is learned from labelled documents that are not held out, unless given; a document labelled twice is toxic if
    one label says so, and null labels count as none. Null and wordless texts have the score of a text without gains. If
    one kind of label lacks, every score is the share of toxic labels. Whole texts are scored. Repeated rows and null ids
    keep a row each; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))

    def scored(batches):
        by = Gains(sent.value)
        for batch in batches:
            for part in slices(batch, 1):
                score = sent.value.score(by(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = mapped(read, scored, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
