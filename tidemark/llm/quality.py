"""Quality: attention-based multiple-instance learning over passages.

A text is a bag of passages.  Every passage is encoded; gated attention weighs
the passages; the weighted mean stands for the text and a linear layer scores
it.  Only texts are labelled: encoder, attention and score are learned together
from those labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.batches import release_memory, texts_in_chunks, with_fields
from tidemark.llm.bpe import distinct_slices
from tidemark.llm.samples import drawn, fold, texts_of
from tidemark.llm.words import adam, joined, runs, word_slices

PASSAGE = 32
HIDDEN = 16
GATE = 8
#: Labelled texts of each label that the model is fitted on, at most.
MAX_PER_LABEL = 1500
STEPS = 150
RATE = 0.02


def _kinds() -> np.ndarray:
    """The kind of each byte, of sixteen."""
    kind = np.full(256, 15, np.uint8)  # other control bytes
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", "!", "?", ";:", "'\"", "()[]{}<>", "-_/\\|", "%$#&*+=@", "\t\r\f\v~^`"]
    for k, group in enumerate(groups):
        kind[[ord(c) for c in group]] = k
    kind[128:] = 14
    return kind


KINDS = _kinds()
N_KINDS = 16
N_FEATURES = N_KINDS * N_KINDS + 4


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of ``PASSAGE`` words, and its text: shares of pairs of byte kinds, and of repeated words."""
    raw, ends = joined(texts)
    start, length = word_slices(raw)
    text_of = np.searchsorted(ends, start, "right")
    heads, owner = runs(text_of, len(texts), PASSAGE)
    if not len(heads):
        return np.zeros((0, N_FEATURES), np.float32), owner
    size = np.diff(np.append(heads, len(start)))
    kind = KINDS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    pair = kind[:-1] * N_KINDS + kind[1:]
    passage_of = np.repeat(np.arange(len(heads)), np.diff(np.append(start[heads], len(raw))))[:-1]
    byte_of = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))[start[0] :]
    inside = (owner[passage_of] == byte_of[:-1]) & (byte_of[1:] == byte_of[:-1])  # not the blanks before a text's first word, nor a pair of two texts
    grid = np.bincount((passage_of * N_KINDS**2 + pair[start[0] :])[inside], minlength=len(heads) * N_KINDS**2).reshape(len(heads), -1).astype(np.float32)
    grid /= np.maximum(1, grid.sum(1, keepdims=True))
    number, words = distinct_slices(raw, start, length)
    run_of = np.repeat(np.arange(len(heads)), size)
    seen = np.unique(run_of * np.int64(len(words)) + number)
    distinct = np.bincount(seen // len(words), minlength=len(heads))
    same = np.append(False, (number[1:] == number[:-1]) & (run_of[1:] == run_of[:-1]))
    return np.concatenate([np.sqrt(grid), np.stack([1 - distinct / size, np.add.reduceat(same, heads, dtype=np.int64) / size, np.add.reduceat(length, heads) / size / 20, size / PASSAGE], 1).astype(np.float32)], 1), owner


@dataclass
class Quality:
    """Encoder (w1, b1), gated attention (v, u, a) and score (w2, b2)."""

    parameters: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        x, owner = passages(texts)
        w1, b1, v, u, a, w2, b2 = self.parameters
        bags = np.zeros((len(texts), HIDDEN))
        if len(x):
            h = np.tanh((x - self.mean) / self.scale @ w1 + b1)
            weight = _attention(h, v, u, a)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            share, _ = _shares(weight, first, len(owner))
            bags[owner[first]] = np.add.reduceat(h * share[:, None], first, axis=0)
        return 1 / (1 + np.exp(-np.clip(bags @ w2 + b2[0], -500, 500)))


def _attention(h: np.ndarray, v: np.ndarray, u: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (np.tanh(h @ v) / (1 + np.exp(-np.clip(h @ u, -60, 60)))) @ a


def _shares(weight: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax within each bag, and the size of each bag."""
    count = np.diff(np.append(first, n))
    e = np.exp(weight - np.repeat(np.maximum.reduceat(weight, first), count))
    return e / np.repeat(np.add.reduceat(e, first), count), count


def fit(rows: list[tuple[str, int]], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Quality:
    """Train on texts and labels 0 and 1, both classes of equal weight; without two classes every score is 0.5."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    p = [make(N_FEATURES, HIDDEN), np.zeros(HIDDEN), make(HIDDEN, GATE), make(HIDDEN, GATE), make(GATE), make(HIDDEN), np.zeros(1)]
    label = np.array([int(y) for _, y in rows], np.float64)
    x, owner = passages([t for t, _ in rows])
    if len(set(label.tolist())) < 2 or not len(x):
        return Quality([*p[:5], np.zeros(HIDDEN), np.zeros(1)], np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = Quality(p, x.mean(0), x.std(0) + 0.02)
    x = (x - model.mean) / model.scale
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    target = label[owner[first]]
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9)) / len(target)

    def gradients() -> list[np.ndarray]:
        w1, b1, v, u, a, w2, b2 = p
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-np.clip(h @ u, -60, 60)))
        share, count = _shares((t * s) @ a, first, len(x))
        bag = np.add.reduceat(h * share[:, None], first, axis=0)
        d = weight * (1 / (1 + np.exp(-np.clip(bag @ w2 + b2[0], -60, 60))) - target)
        d_bag = np.repeat(d[:, None] * w2, count, axis=0)
        along = (h * d_bag).sum(1)
        d_weight = share * (along - np.repeat(np.add.reduceat(share * along, first), count))
        d_gate = d_weight[:, None] * a
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (d_bag * share[:, None] + d_t @ v.T + d_s @ u.T) * (1 - h * h)
        out = [x.T @ d_h, d_h.sum(0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_weight, bag.T @ d, np.array([d.sum()])]
        return [g + 1e-4 * q for g, q in zip(out, p)]

    adam(p, gradients, steps, rate)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_PER_LABEL) -> Quality:
    """Fit on at most ``most`` texts of each label, drawn by the hash of the key; null keys and labels teach nothing."""
    model = fit(texts_of(docs, drawn(labels.filter(F.col(label).isin(0, 1)), key, label, most), key, text, label))
    release_memory()
    return model


def score_quality(docs: DataFrame, model: Quality, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with ``name``, a score from 0 to 1 of the whole text.

    Null, empty and blank texts are bags without passages and get the score of
    none.  Rows are scored one by one; further columns pass, and one that is
    already called ``name`` is replaced.
    """
    held = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts), pa.float64())], names=[*part.schema.names, name])

    return held.mapInArrow(score, with_fields(held, **{name: DoubleType()}))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 3) -> DataFrame:
    """key, held_out, score, predicted: taught by labels outside fold 1, applied to all of ``docs``."""
    model = train(docs, labels.filter(fold(F.col(key), folds) != 1), key, text)
    scored = score_quality(docs.select(key, text), model, text, "score")
    return scored.select(key, (fold(F.col(key), folds) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
