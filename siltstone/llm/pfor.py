"""Patched frame-of-reference coding of token ids.

Image of a run of ids, all integers little-endian:

    magic      4 bytes  b"PFR1"
    n_ids      u64
    n_blocks   u32
    base       u32 x n_blocks      block minimum
    width      u8  x n_blocks      bits of a packed residual
    start      u32 x (n_blocks+1)  byte offset of a block's packed residuals
    exc_start  u32 x (n_blocks+1)  index of a block's first exception
    packed     BLOCK residuals of ``width`` bits each per block, least significant bit first
    exc_at     u8  x n_exceptions  place inside the block
    exc_value  u32 x n_exceptions  whole residual

The width is that of the residual at the ``PERCENTILE`` of its block; wider residuals are
exceptions and leave zero bits in the packed part.  The last block is filled up with its
base.  ``decode_block`` reads one block by the two indexes alone.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.90
_HEAD = struct.Struct("<4sQI")


def encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    whole = np.zeros(blocks * BLOCK, dtype=np.int64)
    whole[:n] = ids
    if n and n < len(whole):
        whole[n:] = whole[(blocks - 1) * BLOCK : n].min()
    whole = whole.reshape(blocks, BLOCK)
    base = whole.min(axis=1) if blocks else np.zeros(0, dtype=np.int64)
    rest = whole - base[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(PERCENTILE * BLOCK))
    width = np.partition(bits, at, axis=1)[:, at] if blocks else np.zeros(0, dtype=np.uint8)
    outlier = bits > width[:, None]
    start = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=start[1:])
    packed = np.zeros(int(start[-1]), dtype=np.uint8)
    low = np.where(outlier, 0, rest).astype("<u4")
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            spread = np.unpackbits(low[rows].view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(w), bitorder="little").reshape(len(rows), -1)
            packed[start[rows][:, None] + np.arange(int(w) * BLOCK // 8)] = np.packbits(spread, axis=1, bitorder="little")
    _, place = np.nonzero(outlier)
    exc = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(outlier.sum(axis=1), out=exc[1:])
    return b"".join([
        _HEAD.pack(MAGIC, n, blocks), base.astype("<u4").tobytes(), width.tobytes(), start.astype("<u4").tobytes(), exc.astype("<u4").tobytes(),
        packed.tobytes(), place.astype(np.uint8).tobytes(), rest[outlier].astype("<u4").tobytes(),
    ])


def _parts(image: bytes):
    magic, n, blocks = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference image")
    at, out = _HEAD.size, []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u4", blocks + 1), ("<u4", blocks + 1)):
        out.append(np.frombuffer(image, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    base, width, start, exc = out
    packed = np.frombuffer(image, dtype=np.uint8, count=int(start[-1]), offset=at)
    at += packed.nbytes
    place = np.frombuffer(image, dtype=np.uint8, count=int(exc[-1]), offset=at)
    value = np.frombuffer(image, dtype="<u4", count=int(exc[-1]), offset=at + place.nbytes)
    return n, base, width, start, exc, packed, place, value


def decode(image: bytes) -> np.ndarray:
    """All ids (uint32)."""
    n, base, width, start, exc, packed, place, value = _parts(image)
    rest = np.zeros((len(base), BLOCK), dtype=np.int64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bytes_ = packed[start[rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            spread = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
            spread[:, :, :w] = np.unpackbits(bytes_, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            rest[rows] = np.packbits(spread, axis=2, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
    owner = np.repeat(np.arange(len(base)), np.diff(exc.astype(np.int64)))
    rest[owner, place] = value
    return (rest + base[:, None]).reshape(-1)[:n].astype("<u4")


def decode_block(image: bytes, block: int) -> np.ndarray:
    """The ids of one block, by the index."""
    n, base, width, start, exc, packed, place, value = _parts(image)
    w = int(width[block])
    rest = np.zeros(BLOCK, dtype=np.int64)
    if w:
        spread = np.unpackbits(packed[int(start[block]) : int(start[block + 1])], bitorder="little").reshape(BLOCK, w)
        rest = spread.astype(np.int64) @ (1 << np.arange(w, dtype=np.int64))
    own = slice(int(exc[block]), int(exc[block + 1]))
    rest[place[own]] = value[own]
    return (rest + int(base[block]))[: n - block * BLOCK].astype("<u4")
