"""Patched frame-of-reference coding of token ids, vectorized over the blocks of many documents.

A document is `<u4 count><u4 blocks><u4 start of each block>` and its blocks. A block holds up to 256 ids:
`<u4 minimum><u1 width><u1 exceptions><u1 ids - 1><u1 bytes of an exception>`, the ids less the minimum packed at `width`
bits, then the exceptions' positions (one byte each) and their full differences. The width is the one of those that the
90th, 95th, 99th and 100th percentile need which makes the block smallest. A block has less than 256 exceptions, as the
90th percentile leaves a tenth at most.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
HEAD = 8
PERCENTILES = (90, 95, 99, 100)
AT_ONCE = 4096
#: Bits that each number below 2**16 needs.
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bits_of_all(x: np.ndarray) -> np.ndarray:
    """Bits that each number below 2**32 needs, one byte each."""
    low = BITS[(x & np.uint32(0xFFFF)).astype(np.uint16)]
    return low if x.max(initial=0) < 1 << 16 else np.where(x >> 16 > 0, 16 + BITS[(x >> 16).astype(np.uint16)], low).astype(np.uint8)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width`-bit numbers, eight at a time, as rows of bytes, lowest bits first."""
    rows, per = values.shape
    if width == 0:
        return np.empty((rows, 0), np.uint8)
    if width > 16:
        bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32) & np.uint32(1)).astype(np.uint8)
        return np.packbits(bits.reshape(rows, per * width), axis=1, bitorder="little")
    v = values.astype(np.uint64).reshape(rows, per // 8, 2, 4)
    w = np.uint64(width)
    four = v[..., 0] | v[..., 1] << w | v[..., 2] << w * np.uint64(2) | v[..., 3] << w * np.uint64(3)
    both = np.empty((rows, per // 8, 2), "<u8")
    if width == 16:
        both[:] = four
    else:
        both[..., 0] = four[..., 0] | four[..., 1] << w * np.uint64(4)
        both[..., 1] = four[..., 1] >> np.uint64(64 - 4 * width)
    return np.ascontiguousarray(both.view(np.uint8)[..., :width]).reshape(rows, per // 8 * width)


def unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes of `packed` as rows of numbers."""
    rows = data.shape[0]
    per = BLOCK
    if width == 0:
        return np.zeros((rows, per), np.uint32)
    if width > 16:
        bits = np.unpackbits(data, axis=1, bitorder="little").reshape(rows, per, width)
        return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    both = np.zeros((rows, per // 8, 16), np.uint8)
    both[..., :width] = data.reshape(rows, per // 8, width)
    both = both.view("<u8")
    w, mask = np.uint64(width), np.uint64((1 << width) - 1)
    four = np.empty((rows, per // 8, 2), np.uint64)
    if width == 16:
        four[:] = both
    else:
        four[..., 0] = both[..., 0]
        four[..., 1] = both[..., 0] >> w * np.uint64(4) | both[..., 1] << np.uint64(64 - 4 * width)
    out = np.empty((rows, per // 8, 2, 4), np.uint32)
    for k in range(4):
        out[..., k] = four >> w * np.uint64(k) & mask
    return out.reshape(rows, per)


def encode(documents: list[np.ndarray]) -> list[bytes]:
    """The bytes of each document."""
    counts = np.array([len(d) for d in documents], np.int64)
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    if not total:
        return [np.zeros(2, "<u4").tobytes() for _ in documents]
    last = np.cumsum(blocks) - 1
    held = np.full(total, BLOCK, np.int64)
    filled = blocks > 0
    held[last[filled]] = (counts - (blocks - 1) * BLOCK)[filled]
    values = np.zeros((total, BLOCK), np.uint32)
    inside = np.arange(BLOCK) < held[:, None]
    values[inside] = np.concatenate(documents)
    low = np.where(inside, values, np.uint32(0xFFFFFFFF)).min(axis=1)
    values = np.where(inside, values - low[:, None], np.uint32(0))
    need = bits_of_all(values)
    ranked = np.sort(need, axis=1, kind="stable")  # what a short block lacks stands first, as zeros
    wide = np.where(ranked[:, -1] > 16, 4, 2)
    best, width, n_over = np.full(total, np.iinfo(np.int64).max), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for p in PERCENTILES:
        at = BLOCK - held + np.maximum(-(-held * p // 100) - 1, 0)
        w = ranked[np.arange(total), at]
        over = (need > w[:, None]).sum(axis=1)
        cost = -(-held // 8) * w + over * (1 + wide)
        less = cost < best
        best, width, n_over = np.where(less, cost, best), np.where(less, w, width), np.where(less, over, n_over)
    row, col = np.nonzero(need > width[:, None])
    full = values[row, col].astype("<u4")
    values[row, col] = 0
    spots, fours, twos = col.astype(np.uint8).tobytes(), full.tobytes(), full.astype("<u2").tobytes()
    body = -(-held // 8) * width
    head = np.empty((total, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5], head[:, 6], head[:, 7] = width, n_over, held - 1, wide
    heads, bodies = head.tobytes(), [b""] * total
    lengths = body.tolist()
    for w in np.unique(width[width > 0]).tolist():
        of_width = np.flatnonzero(width == w)
        for k in range(0, len(of_width), AT_ONCE):
            some = of_width[k : k + AT_ONCE]
            data = packed(values[some], w)
            step, data = data.shape[1], data.tobytes()
            for j, block in enumerate(some.tolist()):
                bodies[block] = data[j * step : j * step + lengths[block]]
    sizes = HEAD + body + n_over * (1 + wide)
    over_end = np.cumsum(n_over).tolist()
    ends, over, widths = np.cumsum(sizes), n_over.tolist(), wide.tolist()
    result, block = [], 0
    for count, n in zip(counts.tolist(), blocks.tolist()):
        before = ends[block : block + n] - sizes[block : block + n]
        index = np.concatenate([[count, n], before - (before[0] if n else 0) + 8 + 4 * n]).astype("<u4")
        parts = [index.tobytes()]
        for k in range(block, block + n):
            parts += (heads[k * HEAD : (k + 1) * HEAD], bodies[k])
            if over[k]:
                e, b = over_end[k], over_end[k] - over[k]
                parts += (spots[b:e], fours[4 * b : 4 * e] if widths[k] == 4 else twos[2 * b : 2 * e])
        result.append(b"".join(parts))
        block += n
    return result


def decode(documents: list[bytes]) -> list[np.ndarray]:
    """The ids of each document as little-endian unsigned 32-bit numbers."""
    data = np.frombuffer(b"".join(documents), np.uint8)
    begin = np.cumsum([0, *(len(d) for d in documents)])[:-1]
    heads = [np.frombuffer(d, "<u4", 2) for d in documents]
    starts = [np.frombuffer(d, "<u4", int(h[1]), 8).astype(np.int64) + b for d, h, b in zip(documents, heads, begin)]
    at = np.concatenate(starts) if starts else np.empty(0, np.int64)
    if not len(at):
        return [np.empty(0, "<u4") for _ in documents]
    head = data[at[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, n_over, held, wide = (head[:, k].astype(np.int64) for k in (4, 5, 6, 7))
    held += 1
    body = -(-held // 8) * width
    values = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        of_width = np.flatnonzero(width == w)
        for k in range(0, len(of_width), AT_ONCE):
            some = of_width[k : k + AT_ONCE]
            where = (at[some] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)
            values[some] = unpacked(data[np.minimum(where, len(data) - 1)], int(w))
    row = np.repeat(np.arange(len(at)), n_over)
    if len(row):
        rank = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        first = (at + HEAD + body)[row]
        full = np.zeros(len(row), np.uint32)
        for k in range(4):
            some = wide[row] > k
            place = first[some] + n_over[row][some] + rank[some] * wide[row][some] + k
            full[some] |= data[place].astype(np.uint32) << np.uint32(8 * k)
        values[row, data[first + rank]] = full
    values += low[:, None]
    ids = values[np.arange(BLOCK) < held[:, None]].astype("<u4")
    return np.split(ids, np.cumsum([int(h[0]) for h in heads])[:-1])
