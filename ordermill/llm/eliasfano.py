"""Elias-Fano sequences over a memory-mapped file: monotone numbers in about 2 + log2(range / count) bits each.

Low bits are packed side by side; high bits are a bit vector in which the i-th one stands at (high part + i).
All look-ups take arrays of arguments.
"""

from __future__ import annotations

import tempfile

import numpy as np

_BYTES = np.arange(256, dtype=np.uint8)[:, None] >> np.arange(8, dtype=np.uint8) & 1
#: Place of the k-th one in a byte, by byte and k.
_SELECT = np.argsort(1 - _BYTES, axis=1, kind="stable").astype(np.uint8)
_U = np.uint64
#: A one in each byte, and the top bit of each.
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Ones in a row that a window of eight bytes surely shows.
_SHOWN = 56


class MappedFile:
    """An unnamed temporary file that arrays are moved into and mapped from; it goes when its maps do.

    It serves the task that makes it and no other; a retried task makes its own.
    """

    def __init__(self):
        self._file = tempfile.TemporaryFile()

    def put(self, values: np.ndarray) -> np.ndarray:
        if not values.size:
            return values
        self._file.seek(0, 2)
        at = -(-self._file.tell() // 64) * 64
        self._file.truncate(at)
        self._file.seek(at)
        self._file.write(np.ascontiguousarray(values).data)
        self._file.flush()
        return np.memmap(self._file, dtype=values.dtype, mode="r", offset=at, shape=values.shape)


class EliasFano:
    def __init__(self, values: np.ndarray, store: MappedFile):
        values = np.asarray(values, dtype=np.uint64)
        self.size = len(values)
        top = int(values[-1]) + 1 if self.size else 1
        self.low_bits = max(0, (top // max(1, self.size)).bit_length() - 1)
        low = self.low_bits
        self.mask = np.uint64((1 << low) - 1)
        packed = np.zeros(0, dtype=np.uint8)
        if low:
            shifts = np.arange(low, dtype=np.uint64)
            parts = [  # a multiple of eight numbers at a time fills whole bytes
                np.packbits(((values[i : i + 65_536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
                for i in range(0, self.size, 65_536)
            ]
            packed = np.concatenate(parts) if parts else packed
        self.low = store.put(np.concatenate((packed, np.zeros(8, dtype=np.uint8))))
        highs = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(-(-(self.size + (top >> low) + 1) // 64) * 64, dtype=bool)
        bits[highs + np.arange(self.size)] = True
        packed_high = np.packbits(bits, bitorder="little")
        self.high = store.put(np.concatenate((packed_high, np.zeros(8, dtype=np.uint8))))
        self.words = self.high[: len(packed_high)].view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = store.put(ones)
        self.zeros = store.put(64 * np.arange(len(ones)) - ones)

    def _select(self, rank: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the one (or, flipped, the zero) that has ``rank`` others before it.

        Within a word of 64 bits, the ones up to each byte are counted in the bytes of another word.
        """
        at = np.searchsorted(directory, rank, side="right") - 1
        left = (rank - directory[at]).astype(np.uint64)
        word = self.words[at]
        if flip:
            word = ~word
        upto = word - ((word >> _U(1)) & _U(0x5555555555555555))
        upto = (upto & _U(0x3333333333333333)) + ((upto >> _U(2)) & _U(0x3333333333333333))
        upto = ((upto + (upto >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
        passed = np.bitwise_count(((left * _EACH | _TOPS) - upto) & _TOPS).astype(np.uint64)  # bytes that end before the place
        byte = passed << _U(3)
        left -= ((upto << _U(8)) >> byte) & _U(255)
        return at * 64 + byte.astype(np.int64) + _SELECT[(word >> byte) & _U(255), left]

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from a place on."""
        byte, shift = place >> 3, (place & 7).astype(np.uint64)
        window = np.ndarray((len(self.high) - 7,), dtype="<u8", buffer=self.high.data, strides=(1,))
        bits = window[byte] >> shift
        row = np.bitwise_count(bits ^ (bits + _U(1))).astype(np.int64) - 1
        return row

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low_bits
        window = np.ndarray((len(self.low) - 7,), dtype="<u8", buffer=self.low.data, strides=(1,))
        return window[bit >> 3] >> (bit & 7).astype(np.uint64) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        i = np.asarray(i, dtype=np.int64)
        high = self._select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that is not below x, and whether it equals x; ``size`` if none."""
        x = np.asarray(x, dtype=np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        inside = high <= last
        bounded = np.minimum(high, last)
        # elements with this high part stand between two zeros of the bit vector
        before = np.maximum(bounded - 1, 0)
        start = np.where(bounded > 0, self._select(before, self.zeros, True) + 1, 0)
        lo = start - bounded
        hi = lo + self._ones_from(start)
        long = np.flatnonzero(hi - lo >= _SHOWN)
        hi[long] = self._select(bounded[long], self.zeros, True) - bounded[long]
        lo, hi = np.where(inside, lo, self.size), np.where(inside, hi, self.size)
        end, target = hi.copy(), x & self.mask
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < target[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        equal = lo < end
        at = np.flatnonzero(equal)
        equal[at] = self._low(lo[at]) == target[at]
        return lo, equal
