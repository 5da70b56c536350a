"""Words, runs of words and subwords of many texts at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm.bpe import distinct_slices

#: The white space of ASCII, which is what splits words here (fixed values).
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x9, 0xA, 0xB, 0xC, 0xD]] = True


def joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8, each followed by a line feed, and where each ends."""
    raw = [t.encode() + b"\n" for t in texts]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int64)


def word_slices(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word of ``raw``, which ends in white space."""
    blank = BLANK[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def runs(text_of: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words that don't leave their text: the first word of each, and its text."""
    first = np.searchsorted(text_of, np.arange(n_texts + 1))
    place = np.arange(len(text_of)) - first[text_of]
    heads = np.flatnonzero(place % size == 0)
    return heads, text_of[heads]


def subwords(words: list[bytes], sizes: tuple[int, ...], buckets: int, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of bytes of each word between marks, and of the whole; how many each word has."""
    parts = [_subwords(words[i : i + at_once], sizes, buckets) for i in range(0, max(1, len(words)), at_once)]
    return np.concatenate([bucket for bucket, _ in parts]), np.concatenate([count for _, count in parts])


def _subwords(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    wrapped = [b"<" + w + b">" for w in words]
    length = np.array([len(w) for w in wrapped], np.int64)
    raw = b"".join(wrapped)
    at = np.arange(len(raw))
    left = np.repeat(np.cumsum(length), length) - at  # bytes to the end of the word
    word = np.repeat(np.arange(len(words)), length)
    view = np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))
    found, owner = [], []
    for n in sizes:
        start = np.flatnonzero(left >= n)
        found.append((view[start] & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
        owner.append(word[start])
    hashes = np.concatenate(found) * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each word, lower-cased in ASCII: its text and its number among the distinct words; those."""
    raw, ends = joined(texts)
    raw = raw.lower()
    start, length = word_slices(raw)
    number, distinct = distinct_slices(raw, start, length)
    return np.searchsorted(ends, start, "right"), number, distinct


def adam(parameters: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    """Full-batch Adam in place; ``gradients()`` gives one array for each parameter."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        for p, m, v, g in zip(parameters, first, second, gradients()):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
