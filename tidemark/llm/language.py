"""Language identification: prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes deep.  A byte
is coded in the longest context that has been seen; where that context has
never had it, an escape is coded and the next shorter context is tried, down to
a uniform code.  Statistics are frozen after training, so the code length of a
text is the sum, over its positions, of a fixed number for each ``ORDER`` bytes
and the byte after them; the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tidemark.llm.batches import texts_in_chunks, with_fields
from tidemark.llm.samples import drawn, fold, texts_of

ORDER = 3
#: Texts of each language that the trees are grown from, at most.
MAX_PER_LANG = 300
#: Slots of the table of code lengths that a worker keeps: a bound of its memory.
SLOTS_BITS = 20
UNDETERMINED = "und"


def grams(raw: np.ndarray) -> np.ndarray:
    """At each position the byte and the ``ORDER`` bytes before it, as one number; bytes before the start are 0."""
    padded = np.concatenate([np.zeros(ORDER, np.uint32), raw.astype(np.uint32)])
    n = len(raw)
    out = np.zeros(n, np.uint32)
    for back in range(ORDER, -1, -1):
        out = (out << np.uint32(8)) | padded[ORDER - back : ORDER - back + n]
    return out


@dataclass
class ContextTree:
    """By order: contexts and symbols that were seen, how often, and what escapes each context has.

    A context's escape has the weight of its distinct symbols (method C): of a
    context seen n times with d symbols, a symbol seen c times costs
    -log2(c / (n + d)), an escape -log2(d / (n + d)).
    """

    pairs: list[np.ndarray] = field(default_factory=list)
    cost: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def grown(cls, texts: list[bytes]) -> ContextTree:
        tree = cls()
        seen = np.concatenate([grams(np.frombuffer(t, np.uint8)) for t in texts] or [np.zeros(0, np.uint32)])
        for order in range(ORDER + 1):
            pairs, count = np.unique(seen & np.uint32((1 << (8 * (order + 1))) - 1), return_counts=True)
            contexts, first = np.unique(pairs >> np.uint32(8), return_index=True)
            distinct = np.diff(np.append(first, len(pairs)))
            total = np.add.reduceat(count, first) if len(first) else count
            tree.pairs.append(pairs)
            tree.cost.append(-np.log2(count / np.repeat(total + distinct, distinct)))
            tree.contexts.append(contexts)
            tree.escape.append(-np.log2(distinct / (total + distinct)))
        return tree

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the bytes before it."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[open_] & np.uint32((1 << (8 * (order + 1))) - 1)
            at, hit = _found(self.pairs[order], key)
            out[open_[hit]] += self.cost[order][at[hit]]
            open_, key = open_[~hit], key[~hit]
            at, known = _found(self.contexts[order], key >> np.uint32(8))
            out[open_[known]] += self.escape[order][at[known]]
        out[open_] += 8
        return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Languages:
    """A tree for each language; code lengths of grams are kept in a table of bounded size."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names = sorted({name for _, name in rows})
        self.trees = [ContextTree.grown([t.encode() for t, name in rows if name == own]) for own in self.names]
        self.keys: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"keys": None, "table": None}

    def _bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram in each language, by the table where it has the gram."""
        if self.keys is None:
            self.keys = np.full(1 << SLOTS_BITS, -1, np.int64)
            self.table = np.zeros((1 << SLOTS_BITS, len(self.names)), np.float32)
        slot = ((gram * np.uint32(2654435761)) >> np.uint32(32 - SLOTS_BITS)).astype(np.int64)
        new = np.unique(gram[self.keys[slot] != gram])
        if len(new):
            place = ((new * np.uint32(2654435761)) >> np.uint32(32 - SLOTS_BITS)).astype(np.int64)
            self.keys[place], self.table[place] = new, self._costs(new)  # of two grams of one slot the last stays
        out = self.table[slot]
        missed = np.flatnonzero(self.keys[slot] != gram)
        if len(missed):
            out[missed] = self._costs(gram[missed])
        return out

    def _costs(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(gram) for t in self.trees], 1).astype(np.float32)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language."""
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        out = np.zeros((len(texts), len(self.names)))
        if not size.sum():
            return out
        gram = grams(np.frombuffer(b"".join(raw), np.uint8))
        has = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[has]
        for back in range(ORDER):  # no context reaches into the text before
            at = start[size[has] > back] + back
            gram[at] &= np.uint32((1 << (8 * (back + 1))) - 1)
        out[has] = np.add.reduceat(self._bits(gram), start, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text (of equal code lengths the first name) and its share among all languages."""
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits[np.arange(len(texts)), best][:, None] - bits, -1000)).sum(1)
        return [self.names[b] for b in best], share


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_PER_LANG) -> Languages:
    """Trees from at most ``most`` texts of each language, drawn by the hash of the key; null keys, texts and languages teach nothing."""
    known = docs.filter(F.col(text).isNotNull())
    return Languages(texts_of(known, drawn(known, key, lang, most), key, text, lang))


def identify(docs: DataFrame, model: Languages, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``name`` and ``score`` (0 to 1): the language of the whole text and its share of the probability.

    A null text, an empty one and one without a letter are ``und`` with score
    0, as is every text if the model has learned no language.  Rows are
    independent, so ties and repeated rows get equal answers; further columns
    pass, and those already called ``name`` or ``score`` are replaced.
    """
    held = docs.drop(name, score)
    names_held = held.columns
    columns = [f"c{i}" for i in range(len(held.columns))]  # names that can't clash with that of the mark
    marked = held.toDF(*columns).withColumn("letters", F.coalesce(F.col(columns[names_held.index(text)]).rlike(r"\p{L}"), F.lit(False)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_chunks(batches, columns[names_held.index(text)]):
            letters = part["letters"].to_numpy(zero_copy_only=False)
            if model.names:
                names, share = model.predict(texts)
            else:
                names, share = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            names = [n if ok else UNDETERMINED for n, ok in zip(names, letters)]
            share = np.where(letters, share, 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(share, pa.float64())], names=[*names_held, name, score])

    return marked.mapInArrow(answer, with_fields(held, **{name: StringType(), score: DoubleType()}))


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """key, held_out, lang_pred, score: taught by rows outside fold 0, applied to all of ``docs``."""
    model = train(docs.select(key, text, lang).filter(fold(F.col(key), folds) != 0), key, text, lang)
    found = identify(docs.select(key, text), model, text)
    return found.select(key, (fold(F.col(key), folds) == 0).alias("held_out"), "lang_pred", "score")
