"""Operator 7: chat formatting with offset-aligned loss masks.

A conversation is rendered as `<|turn|>role<|text|>text<|end|>` for each turn. Inside roles and texts a backslash and the
bar of each `<|` get a backslash before them, so no control string can stand there and every text can be had back. The
three control strings are added tokens, at which the tokenizer always cuts; the offsets of the tokens are intersected with
the turns' spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.llm.common import SLICE_BYTES, mapped

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
#: Characters after which a part of a conversation ends, with a turn.
PART = 1 << 20
#: Characters of a text by which turns are dealt; the order by them is that of whole texts.
HEAD = 64
PIECE = "conv_id long, part long, n_turns long, formatted_chars long, loss_chars long, turns string, said string, turns_sha256 binary, loss_sha256 binary"
SHAPE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
_kept: dict = {}


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def tokenizer(path: str):
    """The tokenizer of the file with the control strings as added tokens, kept for as long as the worker lives."""
    if path not in _kept:
        from tokenizers import AddedToken, Tokenizer, processors

        found = Tokenizer.from_file(path)
        found.no_padding()
        found.no_truncation()
        found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        found.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's leading space is its own
        _kept[path] = found
    return _kept[path]


def rendered(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of the turns (role, text), and the spans (start, end) of what assistants say, in ascending order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{TEXT}", escaped(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def masked(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens have a character in a span; both are sorted, tokens without characters are in none."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    change = np.zeros(len(offsets) + 1, np.int64)
    some = last > first
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    return (np.cumsum(change[:-1]) > 0) & (offsets[:, 1] > offsets[:, 0])


def format_conversations(rows: DataFrame, path: str, most: int = PART) -> DataFrame:
    """Parts of conversations: conv_id, part (ascending), formatted, ids, starts and ends (each token's characters), loss
    (whether the loss counts it).

    The turns of a conversation are ordered by turn, role and text, nulls first; repeated rows are turns of their own. Null
    roles and texts are empty. Rows with a null conv_id are one conversation. A part ends with the turn that fills `most`
    characters, so that memory is bounded by that and the longest text. Turns are dealt by ranges of their order, so that a
    long conversation is formatted by many tasks; only turns that are equal in turn, role and the first HEAD characters
    stay together. An empty table gives an empty result; other columns are not read.
    """

    def parts(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32  # partitions are in the order of their ranges
        conv, turns, size, ready, held = None, [], 0, [], 0

        def closed():
            formatted, spans = rendered(turns)
            found = tokenizer(path).encode(formatted, add_special_tokens=False)
            offsets = np.fromiter(chain.from_iterable(found.offsets), np.int32, 2 * len(found)).reshape(-1, 2)
            return conv[0], number, formatted, np.array(found.ids, np.int32), offsets[:, 0], offsets[:, 1], masked(offsets, spans)

        for batch in batches:
            for id_, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if turns and (conv != (id_,) or size >= most):
                    ready.append(closed())
                    number, held, turns, size = number + 1, held + size, [], 0
                    if held >= PART:
                        yield batch_of(ready)
                        ready, held = [], 0
                conv = (id_,)
                turns.append((role, text))
                size += len(role) + len(text)
        if turns:
            ready.append(closed())
        if ready:
            yield batch_of(ready)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    dealt = read.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(dealt, parts, "conv_id long, part long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def batch_of(ready: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch of parts."""
    conv, part, formatted, *lists = zip(*ready)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32)
    columns = [pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(formatted, pa.string())]
    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in lists]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"])


def digests(formatted: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """Per conversation, read back from the parts of `format_conversations`: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. It must be given them as they come, the parts in order.

    Parts are read back where they are. A digest of a whole conversation is one sequence: the conversations at either end
    of a partition, and those beyond `most` characters, may go on elsewhere, so what was read of them moves to one task, which
    streams it.
    """

    def read(batches):
        conv, held, size, done, open_ = None, [], 0, [], False
        for batch in batches:
            ids, numbers, texts = (batch.column(n).to_pylist() for n in ("conv_id", "part", "formatted"))
            lists = [(x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in (batch.column(n) for n in ("starts", "ends", "loss"))]
            for k, id_ in enumerate(ids):
                if conv != (id_,):
                    if held and open_:
                        yield pieces(held)
                    elif held:
                        done.append(whole(held))
                    open_, conv, held, size = conv is None, (id_,), [], 0
                held.append((id_, numbers[k], *told(texts[k], *(x[at[k] : at[k + 1]] for at, x in lists)), None, None))
                size += len(texts[k])
                if size >= most:
                    yield pieces(held)
                    open_, held, size = True, [], 0
                if len(done) >= 1024:
                    yield pieces(done)
                    done = []
        if done or held:
            yield pieces(done + held)

    def joined(batches):
        at, state = None, None

        def closed():
            n, size, loss, told_, said = state
            return pieces([(at[0], 0, n, size, loss, None, None, told_.digest(), said.digest())])

        for batch in batches:
            known = batch.filter(batch.column("turns_sha256").is_valid())
            if known.num_rows:
                yield known
            for row in batch.filter(batch.column("turns_sha256").is_null()).to_pylist():
                if at != (row["conv_id"],):
                    if at is not None:
                        yield closed()
                    at, state = (row["conv_id"],), [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for k, name in enumerate(("n_turns", "formatted_chars", "loss_chars")):
                    state[k] += row[name]
                state[3].update(row["turns"].encode())
                state[4].update(row["said"].encode())
        if at is not None:
            yield closed()

    dealt = mapped(formatted, read, PIECE).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digest = [F.lower(F.hex(c)).alias(c) for c in ("turns_sha256", "loss_sha256")]
    return mapped(dealt, joined, PIECE).select("conv_id", "n_turns", digest[0], "loss_chars", digest[1], "formatted_chars")


def told(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> tuple[int, int, int, str, str]:
    """What a part says: its turns, its characters, those under the mask, role and text of each turn, the text under the mask."""
    turns = [f"{unescaped(role)}\n{unescaped(said)}\n" for role, said in SHAPE.findall(text)]
    said = "".join(unescaped(text[begin:end]) for begin, end in runs(starts, ends, loss))
    return len(turns), len(text), len(said), "".join(turns), said


def whole(held: list[tuple]) -> tuple:
    """One row, with digests, of all pieces of a conversation."""
    id_, number, counts = held[0][0], held[0][1], [sum(x) for x in zip(*(h[2:5] for h in held))]
    return (id_, number, *counts, None, None, *(hashlib.sha256("".join(h[k] for h in held).encode()).digest() for k in (5, 6)))


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch of pieces; those with digests are whole conversations and carry no text."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 2
    names = ["conv_id", "part", "n_turns", "formatted_chars", "loss_chars", "turns", "said", "turns_sha256", "loss_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def runs(starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[tuple[int, int]]:
    """The characters (start, end) of each run of tokens under the mask."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(change[::2], change[1::2])]
