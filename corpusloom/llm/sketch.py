"""Fast similarity sketching of sets: t coordinates filled by rounds of hashed bin placement.

Round i < t hashes every element to one of the t bins; a bin keeps the smallest (round, hash) it
has seen, so earlier rounds win. Rounds go on until all bins are filled. If t rounds leave a bin
empty, round t + j gives bin j the smallest hash over all elements, so 2t rounds always fill every
coordinate. Two sets agree in a coordinate with probability equal to their Jaccard similarity, and
the number of agreements concentrates as if the coordinates were independent.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_LOW = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _round_seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.t = bands, rows, bands * rows
        self.seeds = _round_seeds(self.t)
        self.band_seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        """The t coordinates of a non-empty set of 64-bit hashes."""
        t, n = self.t, len(elements)
        out = np.full(t, _EMPTY, np.uint64)
        done = 0
        while done < t:
            step = min(t - done, max(1, -(-3 * t // n)))
            h = mix(elements[None, :] ^ self.seeds[done : done + step, None])
            bins = ((h >> _S32) * np.uint64(t)) >> _S32
            value = (np.arange(done, done + step, dtype=np.uint64)[:, None] << _S32) | (h & _LOW)
            np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
            done += step
            if (out != _EMPTY).all():
                return out
        for j in np.flatnonzero(out == _EMPTY):
            h = mix(elements ^ self.seeds[t + j]) & _LOW
            out[j] = (np.uint64(t + j) << _S32) | h.min()
        return out

    def band_keys(self, coordinates: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each band of consecutive coordinates."""
        rows = coordinates.reshape(self.bands, self.rows)
        key = self.band_seeds.copy()
        for j in range(self.rows):
            key = mix(key ^ rows[:, j])
        return key.view(np.int64)
