"""Operator 3: benchmark decontamination by n-gram seeds and Smith-Waterman alignment of words.

The test items are the query set. They are taken in blocks of a fixed number of bytes; each block is sent to every task
and meets all documents where they are read, in one scan, so that nothing is shuffled. Every n-gram of an item is a seed,
however common it is. Seeds on neighbouring diagonals point at one region, which is aligned unless it has too few of the
item's words for any alignment to do.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import mapped, slices, text_of

#: Text bytes of the items that a block, and so a broadcast, holds; a longer item stands alone.
BLOCK_BYTES = 4 << 20
#: Distinct runs that a worker remembers.
REMEMBERED = 500_000
MATCH, OTHER, GAP = 2, -1, -1
#: Words that an alignment must be worth at least, all of them for a shorter item: a few common words in a row are chance.
WORDS = 8
#: Cells of one alignment table.
CELLS = 1 << 20


def word_of(run: str) -> str:
    """Lower case, letters and digits alone."""
    return run.lower() if run.isalnum() else "".join(c for c in run.lower() if c.isalnum())


def words_of(text: str) -> list[str]:
    return [w for w in map(word_of, text.split()) if w]


class Codes(dict):
    """run -> the word's code in a block: -1 if no item has it, -2 if it has no letter or digit."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, run):
        word = word_of(run)
        self[run] = code = self.vocabulary.get(word, -1) if word else -2
        return code


@dataclass
class Block:
    """Items as word codes, and their n-grams. An item of less than n words is one n-gram of its own length."""

    n: int
    ids: list = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)

    def add(self, item_id, words: list[str]):
        self.ids.append(item_id)
        self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))

    def grams(self, codes: np.ndarray, n: int) -> np.ndarray:
        """A number for the n words from each place; -1 where one is no item's. Numbers of different n differ."""
        if len(codes) < n:
            return np.empty(0, np.int64)
        base, out, bad = len(self.vocabulary) + 1, np.zeros(len(codes) - n + 1, np.int64), np.zeros(len(codes) - n + 1, bool)
        for k in range(n):
            some = codes[k : len(codes) - n + 1 + k]
            bad |= some < 0
            out = out * base + some + 1
        return np.where(bad, -1, out)

    def places(self) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """n -> n-gram -> (item, place)."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            n = min(self.n, len(item))
            for place, gram in enumerate(self.grams(item, n).tolist()):
                found[n][gram].append((k, place))
        return {n: dict(x) for n, x in found.items()}

    def coded(self, texts: list[str], codes: Codes) -> list[np.ndarray]:
        if len(codes) > REMEMBERED:
            codes.clear()
        out = []
        for text in texts:
            runs = text.split()
            found = np.fromiter(map(codes.__getitem__, runs), np.int64, len(runs))
            out.append(found[found != -2] if (found == -2).any() else found)
        return out


def blocks(items: DataFrame, n: int, text: str, item_id: str):
    """The items in blocks of BLOCK_BYTES; items without words are left out."""
    block, held = Block(n), 0
    for item, content in items.select(F.col(item_id).cast("long"), text_of(text)).toLocalIterator():
        size = len(content.encode())
        words = words_of(content)
        if not words:
            continue
        if block.items and held + size > BLOCK_BYTES:
            yield block
            block, held = Block(n), 0
        block.add(item, words)
        held += size
    if block.items:
        yield block


def there(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of `found` are in the sorted `known`."""
    at = np.searchsorted(known, found)
    return known[np.minimum(at, len(known) - 1)] == found


def aligned(items: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each item against its region, and the region's place where the best alignment ends."""
    rows, width = max(map(len, items)), max(map(len, regions))
    item = np.full((len(items), rows), -7, np.int64)
    region = np.full((len(items), width), -9, np.int64)
    for k, (x, y) in enumerate(zip(items, regions)):
        item[k, : len(x)], region[k, : len(y)] = x, y
    slope = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((len(items), width + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for k in range(rows):
        step = np.where(region == item[:, k, None], MATCH, OTHER)
        score = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        score = np.maximum.accumulate(score + slope, axis=1) - slope  # gaps in the item
        above[:, 1:] = score
        at = score.argmax(axis=1)
        top = score[np.arange(len(items)), at]
        end, best = np.where(top > best, at, end), np.maximum(best, top)
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Per row of `docs` and test item whose alignment scores `least` or more, and is worth WORDS words or the whole item:
    doc_id, item_id, score, end_word.

    The score is the best local alignment's (2 a matching word, -1 a changed, inserted or dropped one) over that of the
    whole item; of equal scores in one document the first place counts; end_word counts the document's words, from 0. Case and punctuation don't count. Whole texts are searched. Found
    are alignments with n of the item's words in a row somewhere, all of them for a shorter item.
    Null and wordless texts and items match nothing, an empty side gives an empty table. Rows that share an id, and items
    that do, each give their rows. Other columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    out = "doc_id long, item_id long, score double, end_word long"
    found = [matches(read, b, least, out) for b in blocks(items, n, text, item_id)]
    result = spark.createDataFrame([], out) if not found else found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def matches(read: DataFrame, block: Block, least: float, out: str) -> DataFrame:
    sent = read.sparkSession.sparkContext.broadcast((block, {n: (np.sort(np.fromiter(x, np.int64, len(x))), x) for n, x in block.places().items()}))

    def search(batches):
        block, known = sent.value
        codes = Codes(block.vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                documents = block.coded(part.column(1).to_pylist(), codes)
                spots = sorted({s for d, words in enumerate(documents) for s in candidates(block, known, d, words)}, key=lambda s: (len(block.items[s[1]]), s))
                best = scored(block, documents, spots, least)
                ids = part.column(0)
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([d for (d, _), _ in rows], pa.int64())),
                        pa.array([block.ids[k] for (_, k), _ in rows], pa.int64()),
                        pa.array([x[0] for _, x in rows], pa.float64()),
                        pa.array([x[1] for _, x in rows], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "end_word"],
                )

    return mapped(read, search, out)


def candidates(block: Block, known: dict, d: int, words: np.ndarray):
    """(document, item, stretch) that a seed points at; a stretch is as long as the item."""
    for n, (grams, places) in known.items():
        found = block.grams(words, n)
        at = np.flatnonzero(found >= 0)
        if len(at):
            at = at[there(grams, found[at])]
            for place, gram in zip(at.tolist(), found[at].tolist()):
                for item, inside in places[gram]:
                    yield d, item, (place - inside) // len(block.items[item])


def stretches(block: Block, document: np.ndarray, item: int, stretch: int) -> tuple[int, np.ndarray]:
    """The place and the words of the region that a spot stands for."""
    size = len(block.items[item])
    pad = size // 4 + 2
    first = max(0, stretch * size - pad)
    return first, document[first : (stretch + 2) * size + pad]


def promising(block: Block, items: list[int], regions: list[np.ndarray], least: float) -> np.ndarray:
    """Which regions have enough of their item's words that an alignment could do, if all of these matched."""
    base = len(block.vocabulary)
    sizes = np.array([len(block.items[k]) for k in items])
    owner = np.repeat(np.arange(len(items)), sizes)
    wanted = np.concatenate([block.items[k] for k in items]) + owner * base
    there_are = np.concatenate(regions)
    of = np.repeat(np.arange(len(items)), [len(x) for x in regions])
    words = np.bincount(owner, np.isin(wanted, (there_are + of * base)[there_are >= 0]), len(items))
    return (words >= least * sizes) & (words >= np.minimum(sizes, WORDS))


def scored(block: Block, documents: list[np.ndarray], spots: list[tuple[int, int, int]], least: float) -> dict:
    """(document, item) -> (score, end) of the best alignment, if it reaches `least`; spots are sorted by item length."""
    fit = []
    for k in range(0, len(spots), 4096):
        some = spots[k : k + 4096]
        may = promising(block, [s[1] for s in some], [stretches(block, documents[s[0]], *s[1:])[1] for s in some], least)
        fit += [some[x] for x in np.flatnonzero(may).tolist()]
    spots = fit
    best: dict[tuple[int, int], tuple[float, int]] = {}
    k = 0
    while k < len(spots):
        longest = len(block.items[spots[min(len(spots), k + 64) - 1][1]])
        some = spots[k : k + max(1, min(64 if longest > 512 else 4096, CELLS // (4 * longest + 8)))]
        k += len(some)
        items = [block.items[item] for _, item, _ in some]
        firsts, regions = zip(*(stretches(block, documents[d], item, stretch) for d, item, stretch in some))
        for (d, item, _), score, end, first in zip(some, *(x.tolist() for x in aligned(items, regions)), firsts):
            size = len(block.items[item])
            share = score / (MATCH * size)
            if share >= least and score >= MATCH * min(size, WORDS) and share > best.get((d, item), (0, 0))[0]:
                best[d, item] = share, first + end
    return best


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs`, whole rows, without those that an item is found in.

    Null and empty texts stay, and all rows if there are no items. Rows that share an id go together, those with a null id stay
    whatever their text. An empty table gives an empty result; other columns may be called anything.
    """
    found = contaminated(docs, items, **options).select(F.col("doc_id").alias("found_id")).where("found_id is not null").distinct()
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")
