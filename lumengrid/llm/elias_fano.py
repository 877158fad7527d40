"""Elias-Fano sequences in memory-mapped files, searched in batches."""

from __future__ import annotations

from pathlib import Path

import numpy as np


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value one after the other, with 8 bytes to spare."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    step = 1 << 16  # a multiple of 8, so that each piece begins at a byte
    for lo in range(0, len(values) if width else 0, step):
        part = np.ascontiguousarray(values[lo : lo + step], "<u8").view(np.uint8).reshape(-1, 8)
        packed = np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little")
        out[lo * width // 8 : lo * width // 8 + len(packed)] = packed
    return out


def read_bits(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values of ``width`` bits (56 at most) at these places."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    found = packed[(bit >> 3)[:, None] + np.arange(8)]
    word = np.ascontiguousarray(found).view("<u8").ravel()
    return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """A sequence of n numbers that never falls, below ``universe``.

    Of each number the lower bits are packed; the upper parts are a bit vector, a one for each
    number and a zero for each step of the upper part, with the ones before each 64 bits
    counted. Everything is in three files that are mapped, not read.
    """

    def __init__(self, values: np.ndarray, universe: int, folder: Path, name: str):
        self.n = len(values)
        self.width = min(56, max(0, (universe // max(1, self.n)).bit_length() - 1))
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        self.steps = (universe >> self.width) + 1
        bits = np.zeros(-(-(self.n + self.steps + 1) // 64) * 64, dtype=bool)
        bits[high + np.arange(self.n)] = True
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))]).astype(np.int64)
        self.lows = self._mapped(pack_bits(values, self.width), folder / f"{name}.low")
        self.highs = self._mapped(np.packbits(bits, bitorder="little"), folder / f"{name}.high")
        self.ones = self._mapped(ones, folder / f"{name}.ones")
        self.zeros = np.arange(len(ones)) * 64 - ones

    @staticmethod
    def _mapped(data: np.ndarray, path: Path) -> np.ndarray:
        data.tofile(path)
        return np.memmap(path, dtype=data.dtype, mode="r") if len(data) else data

    def before_step(self, step: np.ndarray) -> np.ndarray:
        """How many numbers have an upper part less than ``step``: select of the step-th zero."""
        step = np.minimum(step.astype(np.int64), self.steps)
        block = np.searchsorted(self.zeros, step, side="left") - 1
        block = np.maximum(block, 0)
        found = self.highs[block[:, None] * 8 + np.arange(8)]
        zero = 1 - np.unpackbits(np.ascontiguousarray(found), axis=1, bitorder="little").astype(np.int8)
        seen = np.cumsum(zero, axis=1, dtype=np.int8)
        inside = (seen < (step - self.zeros[block])[:, None]).sum(axis=1)
        # bits before the zero, less the zeros before it
        return np.where(step == 0, 0, block * 64 + inside - (step - 1))

    def value(self, at: np.ndarray) -> np.ndarray:
        """The lower bits of the numbers at these places."""
        return read_bits(self.lows, self.width, at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places: the upper part is how many zeros stand before the one of a place."""
        at = at.astype(np.int64)
        block = np.searchsorted(self.ones, at, side="right") - 1
        found = self.highs[block[:, None] * 8 + np.arange(8)]
        one = np.cumsum(np.unpackbits(np.ascontiguousarray(found), axis=1, bitorder="little"), axis=1, dtype=np.int8)
        inside = (one <= (at - self.ones[block])[:, None]).sum(axis=1)
        return ((block * 64 + inside - at).astype(np.uint64) << np.uint64(self.width)) | self.value(at)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, or -1. Among the numbers of its upper part, and between the places
        ``begin`` and ``stop`` where they are given, the first that is not less (its successor) is searched
        by halving."""
        values = values.astype(np.uint64)
        step = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        lo, end = self.before_step(step), self.before_step(step + 1)
        if begin is not None:
            lo, end = np.maximum(lo, begin), np.minimum(end, stop)
        hi = end.copy()
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            less = self.value(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        found = np.full(len(values), -1, dtype=np.int64)
        inside = np.flatnonzero(lo < end)
        same = self.value(lo[inside]) == low[inside]
        found[inside[same]] = lo[inside[same]]
        return found
