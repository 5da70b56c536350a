"""Suffixes of many texts, told apart by their first bytes: block after block, with a difference cover.

A suffix is a place in a blob of bytes.  The cover's places (by their number
modulo ``PERIOD``) are ranked first.  Then one bucket of suffixes after another
is sorted by its first ``PERIOD`` bytes; suffixes that tie are compared by the
ranks of the cover places that follow both at one distance, which any two
places have within a period.  Keys are held for one bucket at a time.
"""

from __future__ import annotations

import numpy as np

PERIOD = 31
#: A difference cover: every difference modulo 31 is one of two of these (fixed values).
COVER = (1, 5, 11, 24, 25, 27)
#: Suffixes sorted at a time, about.
BLOCK = 1 << 18
PAD = 128


def shifts() -> np.ndarray:
    """By two residues: the smallest distance at which both are in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    place = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in reversed(range(PERIOD)):
        both = inside[(place[:, None] + d) % PERIOD] & inside[(place + d) % PERIOD]
        out[both] = d
    return out


class Sorted:
    """Suffixes in order, and which of them begin a group of ties."""

    def __init__(self, places: np.ndarray):
        self.order, self.head = places.copy(), np.zeros(len(places), bool)
        self.head[:1] = True

    def ties(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows that tie with others, and the group of each."""
        group = np.cumsum(self.head) - 1
        rows = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        return rows, group[rows]

    def refine(self, rows: np.ndarray, group: np.ndarray, key: np.ndarray) -> None:
        """Sort these rows, whole groups, by ``key`` within their groups."""
        sub = np.lexsort((key, group))
        self.order[rows] = self.order[rows[sub]]
        key = key[sub]
        self.head[rows] = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))


class Blob:
    """Bytes, ``PAD`` zeros after them, and the eight bytes at each place as a big-endian number."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        held = raw + bytes(PAD)
        self.words = np.ndarray((len(held) - 7,), ">u8", held, strides=(1,))

    def at(self, places: np.ndarray, word: int) -> np.ndarray:
        return self.words[places + 8 * word].astype(np.uint64)


def cover_ranks(blob: Blob, length: int) -> np.ndarray:
    """The rank of each cover place by its first ``length`` bytes or more; 0 elsewhere."""
    places = np.arange(blob.size + PERIOD)
    places = places[np.isin(places % PERIOD, COVER)]
    found = Sorted(places)
    for word in range(-(-length // 8)):
        rows, group = found.ties()
        if not len(rows):
            break
        found.refine(rows, group, blob.at(np.minimum(found.order[rows], blob.size), word))
    ranks = np.zeros(blob.size + PERIOD, np.int32)
    ranks[found.order] = np.cumsum(found.head)
    return ranks


def same_start(raw: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers into ``places`` such that places whose next ``length`` bytes are equal stand together, and the first of each.

    ``length`` is more than ``PERIOD`` and at most 64; each place has as many bytes.
    """
    if not 4 * 8 < length <= 64:
        raise ValueError("length must be from 33 to 64")
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    blob, shift = Blob(raw), shifts()
    ranks = cover_ranks(blob, length)
    lead = (blob.at(places, 0) >> np.uint64(48)).astype(np.int64)
    bucket = np.argsort(lead, kind="stable")
    sizes = np.cumsum(np.bincount(lead, minlength=1 << 16))
    orders, heads, at = [], [], 0
    while at < len(places):
        upto = int(sizes[np.searchsorted(sizes, min(len(places), at + BLOCK))])  # whole buckets
        mine = bucket[at:upto]
        block = _block(blob, ranks, shift, places[mine], length)
        orders.append(mine[block.order])
        heads.append(block.head)
        at = upto
    return np.concatenate(orders), np.concatenate(heads)


def _block(blob: Blob, ranks: np.ndarray, shift: np.ndarray, places: np.ndarray, length: int) -> Sorted:
    """The numbers of ``places`` in order; a head where the first ``length`` bytes differ from those before."""
    found = Sorted(np.arange(len(places)))
    for word in range(4):
        rows, group = found.ties()
        if not len(rows):
            return found
        found.refine(rows, group, blob.at(places[found.order[rows]], word))
    sure, equal = found.head.copy(), np.zeros(len(places), bool)  # equal: of a group that equals its pivot
    while True:
        rows, group = found.ties()
        open_ = ~equal[rows]
        rows, group = rows[open_], group[open_]
        if not len(rows):
            break
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(first, len(rows)))
        place = places[found.order[rows]]
        pivot = np.repeat(place[first + count // 2], count)
        d = shift[place % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[place + d].astype(np.int64) - ranks[pivot + d])
        found.refine(rows, group, side)
        equal[rows] = np.sort(group * 4 + side + 1) % 4 == 1
    check = np.flatnonzero(found.head & ~sure)
    if len(check):
        a, b = places[found.order[check - 1]], places[found.order[check]]
        differ = np.zeros(len(check), bool)
        for word in range(4, -(-length // 8)):
            x = blob.at(a, word) ^ blob.at(b, word)
            left = length - 8 * word
            differ |= (x >> np.uint64(64 - 8 * left) if left < 8 else x) != 0
        found.head[check] = differ
    return found
