"""CRC-32 of any part of a byte sequence from running values, in numpy.

The register after a sequence is linear over GF(2): appending n zero bytes is a matrix, and the
register of ``data[i:j]`` is that of ``data[:j]`` with the one of ``data[:i]``, shifted by j - i
zero bytes, cancelled out. The matrices for 1, 2, 4, ... zero bytes follow from each other by squaring.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
ONES = np.uint32(0xFFFFFFFF)
CHUNK = 64
_CHUNK_POWER = 6


def _byte_steps() -> np.ndarray:
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> np.uint32(1)) ^ np.where(r & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return r


_STEP = _byte_steps()


def _tables(images: np.ndarray) -> np.ndarray:
    """For the images of the 32 single bits, the images of the 256 values of each of the four bytes."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit % 8)) & 1 == 1
        out[bit // 8, has] ^= images[bit]
    return out


def _apply(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return t[0][r & byte] ^ t[1][(r >> np.uint32(8)) & byte] ^ t[2][(r >> np.uint32(16)) & byte] ^ t[3][r >> np.uint32(24)]


def _shift_powers(n: int = 40) -> list[np.ndarray]:
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(_STEP[bits & np.uint32(255)] ^ (bits >> np.uint32(8)))]
    while len(out) < n:
        out.append(_tables(_apply(out[-1], _apply(out[-1], bits))))
    return out


_SHIFT = _shift_powers()


def shift(registers: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The registers after so many further zero bytes each."""
    out, power = registers.copy(), 0
    most = int(zeros.max()) if len(zeros) else 0
    while most >> power:
        at = np.flatnonzero((zeros >> power) & 1)
        out[at] = _apply(_SHIFT[power], out[at])
        power += 1
    return out


class RunningCrc:
    """Registers, from 0, after every byte of a sequence: chunks side by side, then the chunks by doubling."""

    def __init__(self, data: np.ndarray):
        chunks = -(-len(data) // CHUNK)
        padded = np.zeros(chunks * CHUNK, dtype=np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.uint32)
        self.inside = np.zeros((CHUNK + 1, chunks), dtype=np.uint32)
        for k in range(CHUNK):
            r = self.inside[k]
            self.inside[k + 1] = _STEP[(r ^ columns[k]) & np.uint32(255)] ^ (r >> np.uint32(8))
        self.before = np.zeros(chunks + 1, dtype=np.uint32)
        whole, power = self.inside[CHUNK].copy(), 0
        while 1 << power < chunks:
            gap = 1 << power
            whole[gap:] ^= _apply(_SHIFT[_CHUNK_POWER + power], whole[:-gap])
            power += 1
        self.before[1:] = whole

    def at(self, end: np.ndarray) -> np.ndarray:
        """Register after the first ``end`` bytes."""
        chunk, rest = end // CHUNK, end % CHUNK
        out = shift(self.before[chunk], rest)
        part = np.flatnonzero(rest)
        out[part] ^= self.inside[rest[part], chunk[part]]
        return out


def between(start: np.ndarray, end: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes start:end, from the registers before and after them."""
    return after ^ shift(before ^ ONES, end - start) ^ ONES
