"""Anchors of byte windows: a content-defined cut of texts into runs of windows.

The anchor of a window of ``LENGTH`` bytes is its ``GRAM``-byte string of the
least hash, the leftmost of equals. It depends on the window's content alone,
so equal windows, wherever they stand, have equal anchors at equal offsets. A
run is the successive windows of a text that share one anchor; the bytes that
its windows cover are its segment.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100
GRAM = 32
#: Bytes that are cut at once; a longer text is cut in overlapping parts.
CHUNK = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    return np.cumprod(out)


class Cutter:
    """Cuts texts into runs; holds the powers that its hashes need."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        n = CHUNK + 2 * length + 1
        self.up = _powers(int(_P), n)
        self.down = _powers(pow(int(_P), -1, 1 << 64), n)

    def _mixed(self, h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(32))
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def runs(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of the texts that lie in ``data`` at [first, last), in order and apart.

        Returns (text, start, n, gram hash, segment digest); start is a place in ``data``.
        """
        text, start, n, _, gram, digest = self.placed_runs(data, first, last)
        return text, start, n, gram, digest

    def placed_runs(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """``runs`` with the place of the anchor in the first window, after n."""
        width = self.length - self.gram + 1
        total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])))
        none = np.zeros(0, dtype=np.int64)
        if len(data) < self.length:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        hashes = self._mixed((total[self.gram :] - total[: -self.gram]) * self.down[: len(data) - self.gram + 1])
        least = (hashes & ~np.uint64((1 << 22) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)  # the anchor of the window that starts here
        # windows that lie within a text
        count = np.maximum(last - first - self.length + 1, 0)
        text = np.repeat(np.arange(len(first)), count)
        start = np.arange(len(text)) + np.repeat(first - (np.cumsum(count) - count), count)
        if not len(start):
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        place = place[start]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        n = np.diff(np.append(new, len(start)))
        text, start, place = text[new], start[new], place[new]
        digest = (total[start + n - 1 + self.length] - total[start]) * self.down[start]
        digest = self._mixed(digest ^ (n.astype(np.uint64) << np.uint64(48)) ^ ((place - start).astype(np.uint64) << np.uint64(40)))
        return text, start, n, place - start, hashes[place], digest
