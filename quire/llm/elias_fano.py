"""Elias-Fano coding of non-decreasing numbers with a select structure.

``n`` numbers up to ``u`` take about ``2 + log2(u / n)`` bits each: the low
``l`` bits are packed side by side, the high parts are a bit vector in which
number ``i`` is the one at position ``(v >> l) + i``. ``select`` finds the
i-th one: every 512th one's position is sampled, the words from there on are
counted; a stretch of 512 ones that spans more than ``LONG`` bits (a few very
large gaps) has its positions written out, so no lookup walks far. Nothing
holds a 64-bit table of the numbers. All arrays are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 512
LONG = 1 << 14
_HEAD = struct.Struct("<QQBxxxIII")      # n, zeros, low bits, bytes of low, high and explicit parts

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_BYTE_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _BYTE_SELECT[_b, _k] = _at


def _pack_low(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value side by side, eight spare bytes behind."""
    out = []
    # whole bytes per chunk: a multiple of eight values
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out) + b"\0" * 8


def encode(values: np.ndarray) -> bytes:
    """Non-decreasing unsigned numbers as one block of bytes."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    width = low_bits if low_bits <= 56 else 64      # a field and its shift fit one 64-bit load
    low = _pack_low(v & np.uint64((1 << low_bits) - 1), width) if width else b""
    at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
    size = (int(at[-1]) + 1 if n else 0) + 64
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = np.append(at[::EVERY], at[-1] if n else 0).astype("<u4")
    long = np.nonzero(np.diff(samples.astype(np.int64)) > LONG)[0]
    explicit = np.zeros((len(long), EVERY), "<u4")
    for row, block in zip(explicit, long.tolist()):
        ones = at[block * EVERY:(block + 1) * EVERY]
        row[:len(ones)] = ones
    return (_HEAD.pack(n, size, low_bits, len(low), len(high), explicit.nbytes) + samples.tobytes()
            + explicit.tobytes() + high + low)


class EliasFano:
    """Reads what ``encode`` wrote, from any buffer (a file's map as well)."""

    def __init__(self, buffer, at: int = 0):
        buf = memoryview(buffer)
        self.n, _, self.low_bits, n_low, n_high, n_explicit = _HEAD.unpack_from(buf, at)
        at += _HEAD.size
        blocks = -(-self.n // EVERY)
        self.samples = np.frombuffer(buf, "<u4", blocks + 1, at)
        at += self.samples.nbytes
        self.explicit = np.frombuffer(buf, "<u4", n_explicit // 4, at).reshape(-1, EVERY)
        at += n_explicit
        self.bytes = np.frombuffer(buf, np.uint8, n_high, at)
        at += n_high
        self.width = self.low_bits if self.low_bits <= 56 else 64
        # unaligned 64-bit loads: one at every byte
        self.low = (np.ndarray((n_low - 7,), "<u8", buf, at, (1,)) if n_low else None)
        self.end = at + n_low
        self.long = np.diff(self.samples.astype(np.int64)) > LONG
        self.long_row = np.cumsum(self.long) - 1

    def select(self, i: np.ndarray) -> np.ndarray:
        """Positions of the ones number ``i`` (from 0) in the high vector."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.int64)
        block = i // EVERY
        far = self.long[block]
        out[far] = self.explicit[self.long_row[block[far]], i[far] % EVERY]
        near = np.nonzero(~far)[0]
        start = self.samples[block[near]].astype(np.int64)
        byte, left = start >> 3, i[near] % EVERY
        # ones before the sampled one in its byte count as already passed
        left = left + _BYTE_ONES[self.bytes[byte] & ((1 << (start & 7)) - 1).astype(np.uint8)]
        active = np.arange(len(near))
        while len(active):
            ones = _BYTE_ONES[self.bytes[byte[active]]]
            here = left[active] < ones
            done = active[here]
            out[near[done]] = byte[done] * 8 + _BYTE_SELECT[self.bytes[byte[done]], left[done]]
            active, ones = active[~here], ones[~here]
            left[active] -= ones
            byte[active] += 1
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        v = (self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low is not None:
            bit = i * self.width
            low = self.low[bit >> 3] >> (bit & 7).astype(np.uint64)
            v |= low & np.uint64((1 << self.low_bits) - 1)
        return v

    def first_at_least(self, value: int) -> int:
        """Place of the first number >= ``value`` (``n`` if none)."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if int(self.get(np.array([mid]))[0]) < value:
                lo = mid + 1
            else:
                hi = mid
        return lo
