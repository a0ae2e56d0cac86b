"""Token ids of texts by way of their distinct pieces: a piece is encoded once and remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gather(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs ``offset, offset + 1, ...`` of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(offsets - (ends - lengths), lengths)


class PieceCache:
    """Ids of pieces by the 64-bit hash of the piece; holds ``limit`` pieces, then starts anew.

    Within one filling the chance that any two pieces share a hash is below limit**2 / 2**65.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 1 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, keys: np.ndarray, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces ``body[start:end]``, in order, and the number of each piece."""
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self._clear()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = body.tobytes()
            found = self.encode([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            size = np.fromiter((len(x) for x in found), np.int64, len(found))
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, *[np.asarray(x, np.uint32) for x in found]])
            self.keys, self.at, self.size = (
                np.insert(old, place[new], more) for old, more in ((self.keys, distinct[new]), (self.at, at), (self.size, size))
            )
            place = np.searchsorted(self.keys, distinct)
        size = self.size[place][inverse]
        return self.ids[gather(self.at[place][inverse], size)], size
