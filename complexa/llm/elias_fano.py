"""Elias-Fano coding of sorted integers with vectorised access, and flat files of arrays that can be memory-mapped.

A sequence of n sorted values keeps the low l = log2(universe / n) bits of each
value packed, and the high bits in unary: value i sets bit (value >> l) + i.
Running counts per 64-bit word answer select, so ``get`` finds the i-th value
and ``find`` the position of a value (or of its successor) without decoding.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyarrow import fs as pafs

_U = np.uint64
_ONE = _U(1)


def _spread(byte: int) -> np.uint64:
    return _U(byte * 0x0101010101010101)


#: Position of the set bit number r (column) in a byte (row).
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).ravel()


def select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``rank`` (from 0, below the popcount) in each 64-bit word: the byte by its running bit counts, then a table."""
    x = words - ((words >> _ONE) & _spread(0x55))
    x = (x & _spread(0x33)) + ((x >> _U(2)) & _spread(0x33))
    sums = ((x + (x >> _U(4))) & _spread(0x0F)) * _spread(1)  # byte i: set bits of bytes 0 .. i
    full = ((rank * _spread(1) | _spread(0x80)) - sums) & _spread(0x80)  # bytes that end before the bit
    place = np.bitwise_count(full).astype(np.uint64) << _U(3)
    left = rank - ((sums << _U(8)) >> place & _U(0xFF))
    byte = (words >> place) & _U(0xFF)
    return place.astype(np.int64) + _IN_BYTE[(byte << _U(3) | left).astype(np.int64)]


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, zeros: bool) -> np.ndarray:
    """Position of the set (or clear) bit number ``rank`` (from 0)."""
    w = np.searchsorted(before, rank, "right") - 1
    bits = words[w]
    return w * 64 + select_in_word(~bits if zeros else bits, (rank - before[w]).astype(np.uint64))


def _ones_from(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits in a row from position ``at``; -1 if the run goes on into the next word."""
    clear = ~words[at >> 6] >> (at & 63).astype(np.uint64)
    run = np.bitwise_count((clear - _ONE) & ~clear).astype(np.int64)
    return np.where(clear > 0, run, -1)


class EliasFano:
    """``arrays`` holds: low, high (uint64 words), ones, zeros (counts before each word), meta (n, l)."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high = arrays[prefix + "low"], arrays[prefix + "high"]
        self.ones, self.zeros = arrays[prefix + "ones"], arrays[prefix + "zeros"]
        self.n, self.bits = (int(x) for x in arrays[prefix + "meta"])

    @staticmethod
    def encode(values: np.ndarray, universe: int, prefix: str = "") -> dict[str, np.ndarray]:
        """Arrays for sorted uint64 ``values`` below ``universe``."""
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits and n:
            part, at = values & _U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        top = values >> _U(bits)
        size = int(universe >> bits) + n + 2
        high = np.zeros((size + 63) // 64, np.uint64)
        spot = top.astype(np.int64) + np.arange(n, dtype=np.int64)
        np.bitwise_or.at(high, spot >> 6, _ONE << (spot & 63).astype(np.uint64))
        count = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        ones = np.append(0, count[:-1])
        zeros = np.arange(len(high), dtype=np.int64) * 64 - ones
        return {prefix + "low": low, prefix + "high": high, prefix + "ones": ones, prefix + "zeros": zeros,
                prefix + "meta": np.array([n, bits], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (value | rest) & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        top = _select(self.high, self.ones, i, False) - i
        return top.astype(np.uint64) << _U(self.bits) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first value >= x, is it x) for uint64 ``x`` below the universe."""
        top = (x >> _U(self.bits)).astype(np.int64)
        # values of a bucket are the set bits between two clear ones
        first = np.where(top > 0, _select(self.high, self.zeros, np.maximum(top - 1, 0), True) + 1, 0)
        start, run = first - top, _ones_from(self.high, first)
        end = start + run
        if len(long := np.flatnonzero(run < 0)):
            end[long] = _select(self.high, self.zeros, top[long], True) - top[long]
        part = x & _U((1 << self.bits) - 1)
        found = np.zeros(len(x), bool)
        size, lo, hi = end - start, start, end.copy()
        one = np.flatnonzero(size == 1)  # most buckets hold one value
        low = self._low(lo[one])
        found[one] = low == part[one]
        lo[one] += low < part[one]
        many = np.flatnonzero(size > 1)
        open_ = many
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < part[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = many[lo[many] < end[many]]
        found[hit] = self._low(lo[hit]) == part[hit]
        return lo, found


# ------------------------------------------------------------------ files
def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write the arrays to one new file below ``folder`` (a URI); its path.  Every attempt of a task has its own file."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    path, at, index = f"{base}/{name}-{uuid.uuid4().hex}", 0, {}
    for k, a in arrays.items():
        index[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    with store.open_output_stream(path, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head.ljust(-(-(len(head) + 8) // 64) * 64 - 8))
        for a in arrays.values():
            raw = np.ascontiguousarray(a)
            out.write(memoryview(raw).cast("B") if a.nbytes else b"")
            out.write(b"\0" * (-raw.nbytes % 64))
    return path


def map_arrays(folder: str, path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read."""
    store, _ = pafs.FileSystem.from_uri(folder)
    if isinstance(store, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(size + 8) // 64) * 64
    return {k: np.frombuffer(raw, np.dtype(kind), n, base + at) for k, (kind, at, n) in json.loads(raw[8:8 + size].tobytes()).items()}
