"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block: n (u16), exceptions (u16), least value (u32), width (u8), then the values minus the least
one, `width` bits each in 64-bit little-endian words, then the exceptions' places (u16) and whole
differences (u32). Differences that don't fit are exceptions; their low bits are packed as well.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 1024
#: Values that are packed or unpacked at once, or one sequence.
AT_ONCE = 1 << 18
_HEAD = struct.Struct("<HHIB")


def _groups(lengths: list[int]) -> Iterator[slice]:
    first = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > AT_ONCE:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield slice(first, len(lengths))


def _layout(size: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every value of blocks in a row: its block, place, word and the bit it starts at; of every block its words and the first of them."""
    block = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(block)) - (np.cumsum(size) - size)[block]
    words = size * width + 63 >> 6
    first = np.cumsum(words) - words
    bit = place * width[block]
    return block, place, first[block] + (bit >> 6), (bit & 63).astype(np.uint64), words, first


def _masks(width: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)


def write_many(sequences: list[np.ndarray], percentile: float = 0.95, block: int = BLOCK) -> Iterator[tuple[bytes, list[int]]]:
    """For each sequence its blocks and where each block starts; an empty sequence has none."""
    if not 1 <= block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} values")
    for group in _groups([len(x) for x in sequences]):
        yield from _write(sequences[group], percentile, block)


def _write(sequences: list[np.ndarray], percentile: float, block: int) -> Iterator[tuple[bytes, list[int]]]:
    lengths = np.array([len(x) for x in sequences], np.int64)
    blocks = (lengths + block - 1) // block
    if not blocks.any():
        yield from ((b"", []) for _ in sequences)
        return
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(block, np.repeat(lengths, blocks) - nth * block)
    v = np.concatenate(sequences).astype(np.uint64)
    low = np.minimum.reduceat(v, np.cumsum(size) - size)
    v -= np.repeat(low, size)
    # the least width that more than the percentile's share of a block's values fit in
    bits = np.frexp(v.astype(np.float64))[1]
    upto = np.bincount(np.repeat(np.arange(len(size)), size) * 33 + bits, minlength=33 * len(size)).reshape(-1, 33).cumsum(1)
    width = (upto > np.minimum(size - 1, (percentile * size).astype(np.int64))[:, None]).argmax(1)
    at, place, word, shift, words, first = _layout(size, width)
    wide = width[at]
    bad = np.flatnonzero(bits > wide)
    fit = v & _masks(width)[at]
    body = np.zeros(words.sum() + 1, np.uint64)
    change = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
    body[word[change]] = np.bitwise_or.reduceat(fit << shift, change)
    over = np.flatnonzero(shift + wide.astype(np.uint64) > np.uint64(64))
    body[word[over] + 1] |= fit[over] >> (np.uint64(64) - shift[over])
    body, places, whole = body.astype("<u8").tobytes(), place[bad].astype("<u2").tobytes(), v[bad].astype("<u4").tobytes()
    n_bad = np.bincount(at[bad], minlength=len(size))
    ends = np.cumsum(n_bad)
    rows = zip(size.tolist(), n_bad.tolist(), low.tolist(), width.tolist(), first.tolist(), (first + words).tolist(), (ends - n_bad).tolist(), ends.tolist())
    parts = [_HEAD.pack(n, k, least, w) + body[8 * a : 8 * b] + places[2 * c : 2 * d] + whole[4 * c : 4 * d] for n, k, least, w, a, b, c, d in rows]
    i = 0
    for n in blocks.tolist():
        starts, total = [], 0
        for part in parts[i : i + n]:
            starts.append(total)
            total += len(part)
        yield b"".join(parts[i : i + n]), starts
        i += n


def read_many(stored: list[tuple[bytes, list[int]]]) -> Iterator[np.ndarray]:
    """The sequences of write_many's rows."""
    for group in _groups([len(s) * BLOCK for _, s in stored]):
        yield from _read(stored[group])


def _read(stored: list[tuple[bytes, list[int]]]) -> Iterator[np.ndarray]:
    heads, bodies, places, whole, lengths = [], [], [], [], []
    for data, starts in stored:
        n_all = 0
        for at in starts:
            n, bad, low, width = _HEAD.unpack_from(data, at)
            at += _HEAD.size
            end = at + 8 * (n * width + 63 >> 6)
            bodies.append(data[at:end])
            if bad:
                places.append(data[end : end + 2 * bad])
                whole.append(data[end + 2 * bad : end + 6 * bad])
            heads.append((n, bad, low, width))
            n_all += n
        lengths.append(n_all)
    if not heads:
        yield from (np.empty(0, "<u4") for _ in stored)
        return
    size, n_bad, low, width = np.array(heads, np.int64).T
    block, _, word, shift, _, _ = _layout(size, width)
    body = np.frombuffer(b"".join(bodies) + bytes(8), "<u8")
    v = body[word] >> shift
    over = np.flatnonzero(shift + width[block].astype(np.uint64) > np.uint64(64))
    v[over] |= body[word[over] + 1] << (np.uint64(64) - shift[over])
    v &= _masks(width)[block]
    if places:
        v[np.repeat(np.cumsum(size) - size, n_bad) + np.frombuffer(b"".join(places), "<u2")] = np.frombuffer(b"".join(whole), "<u4")
    ids, at = (v + low.astype(np.uint64)[block]).astype("<u4"), 0
    for n in lengths:
        yield ids[at : at + n]
        at += n


def write(ids: np.ndarray, percentile: float = 0.95, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """The blocks of one sequence and where each block starts."""
    return next(write_many([ids], percentile, block))


def read_block(data: bytes, at: int) -> np.ndarray:
    return read(data, [at])


def read(data: bytes, starts: list[int]) -> np.ndarray:
    return next(read_many([(data, starts)]))
