"""Toxicity: bags of subword embeddings, averaged, into a linear softmax.

A word is the mean of the embeddings of its character n-grams, so a misspelling
shares most of its vector with the word it stands for; a run of words is the
mean of its words; a linear softmax over the run's mean gives its margin, and
the text's margin is the soft maximum over its runs, less the log of their
number, in training and in scoring: a long text does not drown a toxic passage,
nor gain by being long.  Embeddings and softmax are trained jointly in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.batches import release_memory, texts_in_chunks, with_fields
from tidemark.llm.samples import drawn, fold, texts_of
from tidemark.llm.words import adam, numbered_words, runs, subwords

#: Words of a run.
RUN = 4
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
#: Of the softmax: one word in a run of others has to be enough.
SCALE = 32
#: Labelled texts of each label that the model is fitted on, at most.
MAX_PER_LABEL = 1500
#: Buckets that fewer texts of the sample have are left at zero: they can only name single texts.
MIN_TEXTS = 5
STEPS = 40
#: Of the log odds in the embeddings before the first step, and by how many standard errors they are drawn to 0.
START, SURE = 0.5, 3.0
#: Pull of the embeddings to where they start: rare subwords, of which the sample says little, stay near it.
PULL = 1e-2
RATE = 0.05
#: Words of whole texts that training takes at a time; the sum over them is the full batch.
AT_ONCE = 50_000


def pooled(margin: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the mean of exp(margin) over the runs of each text, which begin at ``head``; its derivative for each run."""
    n = np.diff(np.append(head, len(margin)))
    top = np.maximum.reduceat(margin, head)
    e = np.exp(margin - np.repeat(top, n))
    total = np.add.reduceat(e, head)
    return top + np.log(total / n), e / np.repeat(total, n)


@dataclass
class Toxicity:
    """Of each bucket: what its embedding adds to the margin between the two classes."""

    weight: np.ndarray
    bias: float

    def margins(self, texts: list[str]) -> np.ndarray:
        text_of, number, words = numbered_words(texts)
        out = np.full(len(texts), self.bias)
        if not len(number):
            return out
        bucket, count = subwords(words, SIZES, BUCKETS)
        has = count > 0
        word = np.zeros(len(words))
        word[has] = np.add.reduceat(self.weight[bucket], (np.cumsum(count) - count)[has]) / count[has]
        heads, run_text = runs(text_of, len(texts), RUN)
        size = np.diff(np.append(heads, len(number)))
        run = np.add.reduceat(word[number], heads) / size + self.bias
        first = np.flatnonzero(np.append(True, run_text[1:] != run_text[:-1]))
        out[run_text[first]] = pooled(run, first)[0]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -500, 500)))


def _common(bucket: np.ndarray, count: np.ndarray, number: np.ndarray, text_of: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that ``MIN_TEXTS`` texts or more have, the place of each entry among them, or -1, and the log odds of each, less ``SURE`` standard errors, with which training starts."""
    start = np.cumsum(count) - count
    by_label = np.zeros((2, BUCKETS), np.int64)
    for i, j in _spans(np.searchsorted(text_of, np.arange(len(label) + 1))):
        of = text_of[i:j] - text_of[i] if j > i else text_of[i:j]
        pairs = np.unique(of * np.int64(len(count)) + number[i:j])  # a text and a word of it
        texts, words = pairs // len(count), pairs % len(count)
        size = count[words]
        entry = np.repeat(start[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.unique(np.repeat(texts, size) * BUCKETS + bucket[entry])
        toxic = label[both // BUCKETS + (text_of[i] if j > i else 0)]
        for y in (0, 1):
            by_label[y] += np.bincount(both[toxic == y] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(by_label.sum(0) >= MIN_TEXTS)
    share = (by_label[:, used] + 1) / (np.bincount(label, minlength=2)[:, None] + 2)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    odds, error = np.log(share[1] / share[0]), np.sqrt((1 / (by_label[:, used] + 1)).sum(0))
    return used, place[bucket], np.sign(odds) * np.maximum(0, np.abs(odds) - SURE * error)


def _spans(bounds: np.ndarray) -> list[tuple[int, int]]:
    """From ``bounds[0]`` to the last bound in steps of about ``AT_ONCE`` that end at a bound."""
    out, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
        out.append((int(bounds[at]), int(bounds[to])))
        at = to
    return out


def fit(rows: list[tuple[str, int]], steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Toxicity:
    """Train embeddings and softmax on texts and labels 0 and 1, both classes of equal weight; one class alone, or texts without words, score everything low."""
    label = np.array([int(y) for _, y in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return Toxicity(np.zeros(BUCKETS, np.float32), -1.0)
    text_of, number, words = numbered_words([t for t, _ in rows])
    if not words:
        return Toxicity(np.zeros(BUCKETS, np.float32), -1.0)
    bucket, count = subwords(words, SIZES, BUCKETS)
    heads, run_text = runs(text_of, len(rows), RUN)
    run_size = np.diff(np.append(heads, len(number)))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), count)
    used, bucket, odds = _common(bucket, count, number, text_of, label)
    owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
    count = np.maximum(count, 1).astype(np.float32)
    text_head = np.flatnonzero(np.append(True, run_text[1:] != run_text[:-1]))
    texts = run_text[text_head]
    runs_of_text = np.diff(np.append(text_head, len(run_text)))
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))[texts] / len(texts)
    target = label[texts].astype(np.float32)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (DIM, len(used))).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    emb[0], soft[0] = START * odds, (-0.5, 0.5)
    prior = emb.copy()

    def model() -> Toxicity:
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = SCALE * ((soft[:, 1] - soft[:, 0]) @ emb)
        return Toxicity(weights, float(bias[1] - bias[0]))

    bias = np.zeros(2, np.float32)
    start = model()
    margin = np.concatenate([start.margins([t for t, _ in rows[i : i + 32]]) for i in range(0, len(rows), 32)])
    bias += np.array([0.25, -0.25], np.float32) * (np.median(margin[label == 0]) + np.median(margin[label == 1]))  # between the classes
    summed = lambda at, rows, n: np.stack([np.bincount(at, v, n).astype(np.float32) for v in rows])
    spans = _spans(np.append(text_head, len(run_text)))

    def gradients() -> list[np.ndarray]:
        word = summed(owner, (e[bucket] for e in emb), len(words)) / count
        d_word, d_soft, d_bias = np.zeros_like(word), np.zeros_like(soft), np.zeros_like(bias)
        for i, j in spans:  # runs i to j
            here, size = slice(*np.searchsorted(text_head, (i, j))), run_size[i:j]
            inside = number[heads[i] : heads[i] + size.sum()]
            run_of = np.repeat(np.arange(j - i), size)
            head, runs_in = text_head[here] - i, runs_of_text[here]
            run = summed(run_of, (w[inside] for w in word), j - i) / size
            z = SCALE * (soft.T @ run) + bias[:, None]
            margin = z[1] - z[0]
            whole, share = pooled(margin, head)
            d_text = weight[here] * (1 / (1 + np.exp(-np.clip(whole, -60, 60))) - target[here])
            d_margin = (np.repeat(d_text, runs_in) * share).astype(np.float32)
            d_z = np.stack([-d_margin, d_margin])
            d_run = SCALE * (soft @ d_z) / size
            d_word += summed(inside, (d[run_of] for d in d_run), len(words))
            d_soft += SCALE * (run @ d_z.T)
            d_bias += d_z.sum(1)
        d_word /= count
        return [summed(bucket, (d[owner] for d in d_word), len(used)) + PULL * (emb - prior), d_soft + 1e-5 * soft, d_bias]

    adam([emb, soft, bias], gradients, steps, rate)
    return model()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_PER_LABEL) -> Toxicity:
    """Fit on at most ``most`` texts of each label, drawn by the hash of the key; null keys and labels teach nothing."""
    model = fit(texts_of(docs, drawn(labels.filter(F.col(label).isin(0, 1)), key, label, most), key, text, label))
    release_memory()
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with ``name``, a score from 0 to 1 of the whole text.

    Null, empty and blank texts get the score of no words.  Rows are scored
    one by one, so ties and repeated rows get equal scores; further columns
    pass, and one that is already called ``name`` is replaced.
    """
    held = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts), pa.float64())], names=[*part.schema.names, name])

    return held.mapInArrow(score, with_fields(held, **{name: DoubleType()}))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """key, held_out, score, predicted: taught by labels outside fold 0, applied to all of ``docs``."""
    model = train(docs, labels.filter(fold(F.col(key), folds) != 0), key, text)
    scored = score_toxicity(docs.select(key, text), model, text, "score")
    return scored.select(key, (fold(F.col(key), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
