"""Collection Burrows-Wheeler transform and common prefixes, built column by column.

Every round inserts one symbol of each document: the symbol before the suffix that the last round inserted. The
transform holds one symbol for each suffix in sorted order; where the new suffixes belong follows from the transform
itself (the last-to-first mapping), and their common prefixes with their neighbours from the minimum of the common
prefixes between the two places they came from. Both arrays are files, read from front to back and written anew in each
round; between rounds only one place per document stays in memory. Collections of at most IN_MEMORY bytes keep the two
arrays in memory instead.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

IN_MEMORY = 4 << 20
#: Stands in the transform where no symbol is known yet. UTF-8 has no such byte.
OPEN = 255


def range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of the bytes values[lo:hi] for each pair, 255 for none, through levels of pairwise minima."""
    out = np.full(len(lo), 255, np.uint8)
    own, level = np.flatnonzero(lo < hi), values
    lo, hi = lo[own], hi[own]
    while len(own):
        odd = np.flatnonzero(lo & 1)
        out[own[odd]] = np.minimum(out[own[odd]], level[lo[odd]])
        lo = lo + (lo & 1)
        odd = np.flatnonzero(hi & 1 & (lo < hi))
        out[own[odd]] = np.minimum(out[own[odd]], level[hi[odd] - 1])
        lo, hi = lo >> 1, hi >> 1
        more = np.flatnonzero(lo < hi)
        own, lo, hi = own[more], lo[more], hi[more]
        level = np.minimum(level[0 : len(level) // 2 * 2 : 2], level[1::2])
    return out


class _Column:
    """The bytes of an array between two rounds."""

    def __init__(self, path: str | None):
        self.path, self.held = path, b""

    def write(self, a: np.ndarray) -> None:
        if self.path:
            a.tofile(self.path)
        else:
            self.held = a.copy()

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, np.uint8) if self.path else self.held


def columnwise(documents: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and length of every suffix in sorted order, and its common prefix with the one before, at most `most` (< 255).

    The empty suffixes come first; equal suffixes stand in the order of the documents. Documents have no byte 255.
    """
    n = len(documents)
    size = np.array([len(d) for d in documents], np.int64)
    flat, ends = np.frombuffer(b"".join(documents), np.uint8), np.cumsum(size)
    with tempfile.TemporaryDirectory() as folder:
        files = [_Column(os.path.join(folder, name) if len(flat) > IN_MEMORY else None) for name in ("transform", "prefixes")]
        files[0].write(np.full(n, OPEN, np.uint8))
        files[1].write(np.zeros(n, np.uint8))
        at = np.arange(n)  # where each document's last suffix stands
        live = np.flatnonzero(size > 0)
        depth = 0
        while len(live):
            transform, prefixes = (f.read() for f in files)
            own = at[live]
            transform[own] = flat[ends[live] - 1 - depth]
            order = np.argsort(transform, kind="stable")
            count = len(transform) - (n - len(live))  # documents that have ended keep an open place
            to = np.empty(len(transform), np.int64)
            to[order] = np.arange(len(order))
            own = to[own]
            # prefixes of the new suffixes and of those right after them
            marked = np.zeros(count + 1, bool)
            marked[own] = marked[own + 1] = True
            ask = np.flatnonzero(marked[:count])
            before, here = order[np.maximum(ask - 1, 0)], order[ask]
            same = np.flatnonzero((transform[before] == transform[here]) & (ask > 0))
            value = np.zeros(len(ask), np.uint8)
            value[same] = np.minimum(range_minimum(prefixes, before[same] + 1, here[same] + 1), most - 1) + 1
            # the files anew, with the new suffixes in their places
            old = np.ones(len(transform) + len(live), bool)
            old[n + own] = False
            moved = np.flatnonzero(old)
            wider = np.full(len(old), OPEN, np.uint8)
            wider[moved] = transform
            files[0].write(wider)
            wider[moved] = prefixes
            wider[n + ask] = value
            files[1].write(wider)
            at = moved[at]
            at[live] = n + own
            depth += 1
            live = live[size[live] > depth]
        transform, prefixes = (f.read() for f in files)
    # follow every document from its empty suffix to the whole of it
    owner, length, to = (np.empty(len(transform), np.int64) for _ in range(3))
    to[np.argsort(transform, kind="stable")] = n + np.arange(len(transform))
    at, live = np.arange(n), np.arange(n)
    depth = 0
    while len(live):
        owner[at[live]], length[at[live]] = live, depth
        live = live[size[live] > depth]
        at[live] = to[at[live]]
        depth += 1
    return owner, length, prefixes
