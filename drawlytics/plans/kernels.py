"""Array helpers that run inside a task on one block of draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

from drawlytics.params import STRATEGY_FIB, Game


def balls(rows: pa.Table, game: Game) -> np.ndarray:
    """(rows, pick) numbers of the draws, 0 where missing."""
    return np.column_stack([rows.column(c).fill_null(0).to_numpy() for c in game.ball_cols]).astype(np.int64)


def bonus(rows: pa.Table) -> np.ndarray:
    """Chance numbers, 0 where missing."""
    return rows.column("chance").fill_null(0).to_numpy().astype(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per matrix row."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))


def same(value, n: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def hits(values: np.ndarray, size: int) -> np.ndarray:
    """(rows, size) number of cells equal to 1..size; other values are ignored."""
    values = values.reshape(len(values), -1)
    out = np.zeros((len(values), size + 1), dtype=np.int64)
    at = np.arange(len(values))
    for col in values.T:
        ok = (col >= 1) & (col <= size)
        out[at[ok], col[ok]] += 1
    return out[:, 1:]


def before(per_row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exclusive running sum down the rows, starting from ``entry``."""
    out = np.empty_like(per_row)
    out[0] = entry
    np.cumsum(per_row[:-1], axis=0, out=out[1:])
    out[1:] += entry
    return out


def last_before(hit: np.ndarray, index: np.ndarray, entry: np.ndarray) -> np.ndarray:
    seen = np.where(hit > 0, index[:, None], -1)
    return np.maximum.accumulate(np.vstack([entry[None, :], seen[:-1]]), axis=0)


def seen_before(values: np.ndarray, index: np.ndarray, size: int, stride: int, entry: np.ndarray) -> np.ndarray:
    """Running minimum of ``ball column * stride + draw index`` per number."""
    values = values.reshape(len(values), -1)
    key = np.full((len(values), size + 1), 1 << 62, dtype=np.int64)
    at = np.arange(len(values))
    for pos in range(values.shape[1] - 1, -1, -1):
        ok = (values[:, pos] >= 1) & (values[:, pos] <= size)
        key[at[ok], values[ok, pos]] = pos * stride + index[ok]
    return np.minimum.accumulate(np.vstack([entry[None, :], key[:-1, 1:]]), axis=0)


def settle_digits(x: np.ndarray) -> np.ndarray:
    """Keep 40 bits, so that summation order cannot decide a ranking."""
    m, e = np.frexp(x)
    return np.ldexp(np.round(np.ldexp(m, 40)), e - 40)


def _packed(value: np.ndarray) -> np.ndarray:
    """Integer values and their numbers as one distinct key, larger = better."""
    size = value.shape[1]
    return value * (size + 1) + np.arange(1, size + 1)


def top_numbers(value: np.ndarray, pick: int) -> np.ndarray:
    """Numbers of the ``pick`` largest values per row, best first, the larger
    number first on ties."""
    size = value.shape[1]
    if value.dtype.kind == "f":
        return size - np.argsort(-value[:, ::-1], axis=1, kind="stable")[:, :pick]
    key = _packed(value)
    if pick < size:
        best = np.argpartition(key, size - pick, axis=1)[:, size - pick :]
        key = np.take_along_axis(key, best, axis=1)
    return np.sort(key, axis=1)[:, ::-1] % (size + 1)


def low_numbers(value: np.ndarray, pick: int) -> np.ndarray:
    """Numbers of the ``pick`` smallest values per row, smaller number on ties."""
    if value.dtype.kind == "f":
        return np.argsort(value, axis=1, kind="stable")[:, :pick] + 1
    return np.sort(np.partition(_packed(value), pick - 1, axis=1)[:, :pick], axis=1) % (value.shape[1] + 1)


def fib_rank_weight(cnt: np.ndarray) -> np.ndarray:
    """The repeating rank weights, rank 0 = most frequent (larger number on ties)."""
    order = top_numbers(cnt, cnt.shape[1]) - 1
    weight = np.empty(cnt.shape, dtype=np.int64)
    cycle = np.resize(np.array(STRATEGY_FIB), cnt.shape[1])
    np.put_along_axis(weight, order, np.broadcast_to(cycle, cnt.shape), axis=1)
    return weight


def decayed_before(hit: np.ndarray, entry: np.ndarray, decay: float) -> np.ndarray:
    """Sum of exp(-age/decay) over earlier hits; rows are consecutive draws and
    ``entry`` is relative to the first row."""
    at = np.arange(len(hit))[:, None]
    grown = before(hit * np.exp(at / decay), entry)
    return settle_digits(grown * np.exp((1 - at) / decay))


# ------------------------------------------------------------------ keyed uniforms
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
_MD5_WORD = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(text: bytes, added: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 48 bits of the MD5 of ``n`` equally long texts: ``text``, to whose
    32-bit words (little-endian, by number) the arrays ``added`` are added."""
    padded = text + b"\x80" + b"\x00" * (-(len(text) + 9) % 64) + (8 * len(text)).to_bytes(8, "little")
    words = np.frombuffer(padded, dtype="<u4").tolist()
    state = [np.full(n, s, dtype=np.uint32) for s in _MD5_START]
    f = np.empty(n, dtype=np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            a += f
            at = block + _MD5_WORD[i]
            a += np.uint32((words[at] + _MD5_ADD[i]) & 0xFFFFFFFF)
            if at in added:
                a += added[at]
            np.left_shift(a, np.uint32(_MD5_TURN[i]), out=f)
            np.right_shift(a, np.uint32(32 - _MD5_TURN[i]), out=a)
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        for s, x in zip(state, (a, b, c, d)):
            s += x
    return (state[0].byteswap().astype(np.int64) << 16) | (state[1].byteswap() >> np.uint32(16))


def floyd_matches(head: bytes, index: np.ndarray, hit: np.ndarray, runs: range, total: int, pick: int) -> np.ndarray:
    """Per run, how many numbers random tickets share with draws, summed over the draws.

    The tickets of ``with_floyd_picks`` in mode ``md5``, keyed by ``head``, run,
    position of the draw and step, joined by ``|``; ``hit`` says per draw which
    numbers 0.. it holds. Positions have equally many digits.
    """
    n, width = len(index), len(str(int(index[0])))
    last = np.repeat(np.arange(total - pick + 1, total + 1), n)
    digits = index[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10
    wide = len(str(total))
    steps = np.repeat(np.arange(total - pick + 1, total + 1)[:, None] // 10 ** np.arange(wide - 1, -1, -1) % 10, n, axis=0)
    # Steps of fewer digits than the largest have texts of their own.
    same_wide = all(len(str(j)) == wide for j in range(total - pick + 1, total + 1))
    first, out = np.arange(n) * hit.shape[1], []
    flat, added, size = hit.ravel(), {}, -1
    for run in runs:
        start = head + b"|%d|" % run
        if len(start) != size:
            size, added = len(start), {}
            for column, values in enumerate(np.hstack([np.tile(digits, (pick, 1)), steps]).T):
                place = size + column + (column >= width)
                more = (values << (8 * (place % 4))).astype(np.uint32)
                added[place // 4] = added[place // 4] + more if place // 4 in added else more
        if same_wide:
            key = md5_heads(start + b"0" * width + b"|" + b"0" * wide, added, pick * n)
        else:
            texts = [start + b"%d|%d" % (i, j) for j in range(total - pick + 1, total + 1) for i in index.tolist()]
            key = np.array([int.from_bytes(hashlib.md5(x).digest()[:6], "big") for x in texts])
        drawn = (1 + np.floor(key / 281474976710656.0 * last)).astype(np.int64).reshape(pick, n)
        matched = 0
        for step in range(pick):
            taken = (drawn[:step] == drawn[step]).any(axis=0)
            drawn[step][taken] = total - pick + 1 + step
            matched += int(np.count_nonzero(flat[first + drawn[step]]))
        out.append(matched)
    return np.array(out, dtype=np.int64)
