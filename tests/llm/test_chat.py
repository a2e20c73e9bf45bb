"""Operator 7: exact round trips and masks."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fourfold.llm.chat_format import END, TEXT, TURN, digests, escaped, format_conversations, masked, rendered, tokenizer, unescaped
from fourfold.llm.encoders import public_path

BYTES = public_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, loss string"
nasty = st.text(alphabet="a \\<|>é\n😀[/INST]end", max_size=20) | st.sampled_from([END, TURN, TEXT, "</s>[INST] ok [/INST]", "\\<|end|>", "<", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(nasty, nasty)
def test_escapes(a, b):
    assert unescaped(escaped(a)) == a
    assert not any(x in escaped(a) for x in (TURN, TEXT, END))
    text, _ = rendered([("user", a), ("assistant", b)])
    assert (text.count(TURN), text.count(TEXT), text.count(END)) == (2, 2, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), nasty), min_size=1, max_size=5))
def test_masks(turns):
    text, spans = rendered(turns)
    found = tokenizer(BYTES).encode(text, add_special_tokens=False)
    offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
    slow = [any(s0 < e and e0 > b for b, e in spans.tolist()) for s0, e0 in offsets.tolist()]
    assert masked(offsets, spans).tolist() == slow
    under = sorted({k for (s, e), m in zip(offsets.tolist(), slow) if m for k in range(s, e)})
    assert under == [k for b, e in spans.tolist() for k in range(b, e)]


def told(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for role, t in turns if role == "assistant")
        text = "".join(f"{role}\n{t}\n" for role, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha(text), len(loss), sha(loss), len(rendered(turns)[0]))
    return out


def test_digests(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "  lead and trail  ", ""), (1, 1, "assistant", "  lead and trail  ", ""), (2, 5, "assistant", None, ""), (2, 4, None, "x", "")]
    rows += [(-7, 0, "user", said, ""), (-7, 1, "assistant", said, ""), (None, None, "assistant", "é😀\\<|end|>", ""), (3, 0, "assistant", "long " * 9000, "")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k} {TURN}" * 50, "") for k in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r[0]: tuple(r[1:]) for r in digests(format_conversations(frame, BYTES)).collect()}
    assert found == told(rows)
    assert digests(format_conversations(frame.limit(0), BYTES)).count() == 0


def test_parts(spark):
    """A long conversation is formatted by many tasks, in small parts, and read back whole; so are null ids and equal turns."""
    rows = [(4, k, "assistant" if k % 3 else "user", f"é{k} \\<|" * (k % 5), "") for k in range(300)]
    rows += [(c, 0, "assistant", f"short {c}", "") for c in range(5, 40)]
    rows += [(None, None, "assistant", f"{k % 7}" * 70 + str(k % 3), "") for k in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        formatted = format_conversations(frame, BYTES, most=10)
        parts = [tuple(r) for r in formatted.select("conv_id", "part", "formatted").collect()]
        hot = [(p, t) for c, p, t in parts if c == 4]
        assert len({p >> 32 for p, _ in hot}) > 2
        assert "".join(t for _, t in sorted(hot)) == rendered([(r[2], r[3]) for r in rows if r[0] == 4])[0]
        for held in (1, 50, 1 << 20):
            found = [tuple(r) for r in digests(formatted, most=held).collect()]
            assert {r[0]: r[1:] for r in found} == told(rows) and len(found) == len(told(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
