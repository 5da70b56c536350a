"""Sets of word shingles of many texts, and keys under which similar sets must meet."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from tidemark.llm.bpe import distinct_slices
from tidemark.llm.words import joined, word_slices

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Partitions tried for a set with an empty segment; the last also has keys for empty segments.
ROUNDS = 8
#: Longs of a signature: a bitmap of 64 times as many bits.
LONGS = 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, ascending) of all texts, and where each text's begin (one more entry ends them).

    Words are runs of bytes that aren't white space of ASCII, with A-Z
    lower-cased.  A text of fewer than ``size`` words has their sequence as its
    only shingle; one without words has none.
    """
    raw, ends = joined(texts)
    raw = raw.lower()
    start, length = word_slices(raw)
    number, distinct = distinct_slices(raw, start, length)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[number]
    text_of = np.searchsorted(ends, start, "right")
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    count = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(n) - first[text_of]
    span = np.minimum(count, size)[text_of]  # words of a shingle
    head = np.flatnonzero(place <= count[text_of] - span)
    hashes, owner, span = mixed(span[head].astype(np.uint64)), text_of[head], span[head]
    for i in range(size):
        inside = span > i
        hashes[inside] = mixed((hashes[inside] ^ word[head[inside] + i]) * _A + np.uint64(i))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    hashes, owner = hashes[new], owner[new]
    return hashes, np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))


@dataclass(frozen=True)
class SizeClasses:
    """Classes of set sizes such that two sets that can link share a label.

    A set of a class's sizes has its label; one so large that a set of the
    next class can link to it has the next label as well.  Two linked sets of
    one label differ by ``most(label)`` elements at most, as a similarity of t
    allows (1 - t) / (1 + t) of the sum of the sizes.
    """

    percent: int
    bounds: tuple[int, ...]

    @classmethod
    def of(cls, percent: int, growth: float = 1.45, top: int = 1 << 40) -> SizeClasses:
        bounds, at = [1], 1
        while at < top:
            at = max(at + 1, int(at * max(growth, 100 / percent)) + 1)
            bounds.append(at)
        return cls(percent, tuple(bounds))

    def label(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.bounds), n, "right") - 1

    def next_too(self, n: np.ndarray) -> np.ndarray:
        """Whether sets of the next class can link: its smallest size is at most n * 100 / percent."""
        return np.array(self.bounds)[self.label(n) + 1] * self.percent <= n * 100

    def segments(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By label: into how many segments to deal, and how many may be empty.

        Two linked sets with this label, of whom the larger is below the
        class's end, differ by at most d elements.  With d + 1 + e segments
        they agree on e + 1, of which one isn't empty unless both have more
        than e empty ones; e is about what the smallest sets have by chance.
        """
        bounds = np.array(self.bounds, np.float64)
        most = np.floor(2 * (bounds[label + 1] - 1) * (100 - self.percent) / (100 + self.percent))
        least, spare = np.maximum(1, bounds[label] * self.percent / 100), np.zeros(len(label))
        for _ in range(8):
            parts = most + 1 + spare
            by_chance = parts * np.exp(-least / parts)
            spare = np.where(by_chance < 0.05, 0, np.ceil(by_chance + 2 * np.sqrt(by_chance)))
        return (most + 1 + spare).astype(np.int64), spare.astype(np.int64)


def segment_keys(hashes: np.ndarray, starts: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, so that two sets that link have one in common; where each set's begin.

    A label's elements are dealt into one segment more than two linked sets
    can differ by, so one segment at least is the same in both; sets with more
    empty segments than are allowed for are dealt once more, in another way.
    """
    n = np.diff(starts)
    found, owners = [], []
    sets = np.flatnonzero(n)
    label = classes.label(n[sets])
    up = classes.next_too(n[sets])
    sets, label = np.concatenate([sets, sets[up]]), np.concatenate([label, label[up] + 1])
    for turn in range(ROUNDS):
        if not len(sets):
            break
        size, (parts, spare) = n[sets], classes.segments(label)
        row = np.repeat(np.arange(len(sets)), size)
        element = hashes[np.repeat(starts[sets] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        dealt = mixed(element + mixed(np.array([turn + 1], np.uint64)))
        part = ((dealt >> np.uint64(32)) * parts[row].astype(np.uint64)) >> np.uint64(32)
        base = np.cumsum(parts) - parts
        cell = base[row] + part.astype(np.int64)
        total = parts.sum()
        order = np.argsort(cell, kind="stable")
        cells, at = np.unique(cell[order], return_index=True)
        sums = np.zeros(total, np.uint64)
        sums[cells] = np.add.reduceat(mixed(element * _A)[order], at)
        full = np.zeros(total, bool)
        full[cells] = True
        owner = np.repeat(np.arange(len(sets)), parts)
        tag = mixed((label[owner] * ROUNDS + turn).astype(np.uint64) * _A + (np.arange(total) - base[owner]).astype(np.uint64))
        empty = np.bincount(owner[~full], minlength=len(sets)) > spare
        use = full | (turn == ROUNDS - 1)
        found.append(mixed(sums[use] ^ tag[use]))
        owners.append(sets[owner[use]])
        sets, label = sets[empty], label[empty]
    keys, owner = np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    return keys[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A bitmap of each set: ``LONGS`` words in which each element sets one bit."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    bit = (mixed(hashes * _B) >> np.uint64(32)).astype(np.int64) % (LONGS * 64)
    grid = np.zeros((len(starts) - 1) * LONGS * 64, np.uint8)
    grid[owner * LONGS * 64 + bit] = 1
    return np.packbits(grid, bitorder="little").view("<u8").reshape(-1, LONGS)
