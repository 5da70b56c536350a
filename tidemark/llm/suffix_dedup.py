"""Suffix-array deduplication of byte strings that repeat across documents.

A suffix's bucket is the smallest hash among the 16-byte grams of its first
``length`` bytes, so equal strings are in one bucket wherever they stand.
First the buckets that documents share are found; what moves is hashes, joined
beforehand within each batch.  Then the stretches of text whose suffixes are in
shared buckets are dealt out by bucket; equal stretches are one, and the others'
suffixes are sorted blockwise with a difference cover (see ``suffixes``).  Each
class of equal strings knows its smallest key, and the strings of larger keys
go back to their documents as spans.

Texts move in groups of about ``GROUP_BYTES``: documents by a hash of their row,
buckets by their hash.  Every table between the steps has a row for each pair
of groups, with packed arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.batches import release_memory
from tidemark.llm.bpe import ragged
from tidemark.llm.scratch import discard, tables, written
from tidemark.llm.shingles import mixed
from tidemark.llm.suffixes import same_start

LENGTH = 50
GRAM = 16
#: Bytes of text of a group, about.
GROUP_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
#: Bytes of text whose buckets are joined before they move.
BATCH_BYTES = 16 << 20
#: Suffixes of a stretch at most.
STRETCH = 64
#: A null key: larger than others.
NO_KEY = (1 << 63) - 1
NOWHERE = np.uint32(0xFFFFFFFF)

PACKED = "shard int, chunk int, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = ["shard", "chunk", *"abcdef"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of shard, chunk and arrays."""
    columns = list(zip(*((*r, *[None] * (8 - len(r))) for r in rows))) or [[]] * 8
    pack = zstandard.ZstdCompressor(level=1).compress
    blob = lambda column: pa.array([None if x is None else pack(np.ascontiguousarray(x).tobytes()) for x in column], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *map(blob, columns[2:])], names=NAMES)


def _arrays(table: pa.Table, name: str) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in table[name].to_pylist() if x is not None]


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(_arrays(table, name)), kind)


def _split(owner: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """For each value of ``owner``: it, and the rows of each array that have it."""
    order = np.argsort(owner, kind="stable")
    owners, at = np.unique(owner[order], return_index=True)
    ends = np.append(at, len(order))[1:]
    for k, a, b in zip(owners.tolist(), at.tolist(), ends.tolist()):
        yield (k, *(x[order[a:b]] for x in arrays))


def numbered(bucket: np.ndarray, shards: int) -> np.ndarray:
    """A bucket's shard, and 32 bits of its hash: two buckets of one number are only sorted together."""
    return (mixed(bucket) % np.uint64(shards)) << np.uint64(32) | bucket & np.uint64(0xFFFFFFFF)


def shard_of(number: np.ndarray) -> np.ndarray:
    return (number >> np.uint64(32)).astype(np.int64)


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, suffixes, bucket) of each run of suffixes of one bucket, and of ``STRETCH`` at most."""
    raw = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.view(np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    n, span = len(raw) - GRAM + 1, length - GRAM + 1
    low = mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[8 : 8 + n])
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: step - span], low[span - step :])
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    text_of = np.repeat(np.arange(len(texts)), np.maximum(0, size - length + 1))
    count = np.maximum(0, size - length + 1)
    place = np.arange(len(text_of)) - np.repeat(np.cumsum(count) - count, count)  # in the text
    bucket = low[(end - size)[text_of] + place]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (text_of[1:] != text_of[:-1]))[: len(bucket)]
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(bucket)))
    parts = -(-run // STRETCH)
    which = np.repeat(np.arange(len(head)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = head[which] + part * STRETCH
    return text_of[at], place[at], np.minimum(STRETCH, run[which] - part * STRETCH), bucket[at]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``SLICE_BYTES``, and the number of each one's first."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_BYTES:
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _postings(shards: int, length: int) -> Callable:
    """Of each batch, by shard: its buckets, their smallest key and how much larger the largest is, and the chunk that asks.

    A bucket that two keys of the batch share is known to be shared: its chunks
    are told at once, in rows that pass through, and it is sent on once.
    """

    def flush(bucket: np.ndarray, key: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((key, bucket))
        bucket, key, chunk = bucket[order], key[order], chunk[order]
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        least, most = key[head], key[np.append(head[1:], len(key)) - 1]
        which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
        shared = least < most
        told = shared[which]
        rows = []
        for c, mine in _split(chunk[told], bucket[told]):
            rows.append((c % shards, c, np.unique(mine)))
        pair = np.flatnonzero(~told)
        pair = pair[np.unique(np.stack([which[pair], chunk[pair]]), axis=1, return_index=True)[1]] if len(pair) else pair
        asked = np.concatenate([head[shared], pair])
        to = np.concatenate([np.full(int(shared.sum()), NOWHERE), chunk[pair].astype(np.uint32)])
        found = bucket[asked], least[which[asked]], (most - least)[which[asked]], to
        return _packed(rows + [(s, -1, b.astype(np.uint32), *more) for s, b, *more in _split(shard_of(found[0]), *found)])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key, chunk = batch["key"].to_numpy(), batch["chunk"].to_numpy()
            for begin, texts in _slices(_raw(batch["text"])):
                text_of, _, _, bucket = stretches(texts, length)
                held.append((numbered(bucket, shards), key[begin + text_of], chunk[begin + text_of]))
                size += sum(map(len, texts))
                if size >= BATCH_BYTES:
                    yield flush(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held and sum(len(h[0]) for h in held):
            yield flush(*map(np.concatenate, zip(*held)))
        release_memory()

    return post


def _shared(table: pa.Table) -> pa.Table:
    """(chunk, a): of a shard, the buckets of each chunk that two keys share."""
    asks, shard = table["chunk"].to_numpy() < 0, table["shard"][0].as_py()
    passed = table.filter(pa.array(~asks)).select(["chunk", "a"])
    table = table.filter(pa.array(asks))
    bucket, least, more, to = (_joined(table, c, k) for c, k in zip("abcd", ("<u4", "<i8", "<i8", "<u4")))
    order = np.argsort(bucket, kind="stable")
    bucket, least, most, to = bucket[order], least[order], (least + more)[order], to[order]
    rows = []
    if len(bucket):
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        shared = np.minimum.reduceat(least, head) < np.maximum.reduceat(most, head)
        told = np.repeat(shared, np.diff(np.append(head, len(bucket)))) & (to != NOWHERE)
        full = bucket[told] | np.uint64(shard << 32)
        rows = [(-1, c, np.unique(mine)) for c, mine in _split(to[told].astype(np.int64), full)]
    return pa.concat_tables([passed, pa.Table.from_batches([_packed(rows)]).select(["chunk", "a"])])


class _Chunk:
    """The distinct documents of a chunk, in an order of their own: by key, then by the hash of the text."""

    def __init__(self, table: pa.Table):
        key, tag = table["key"].to_numpy(), table["tag"].to_numpy()
        self.rows = np.lexsort((tag, key))
        k, t = key[self.rows], tag[self.rows]
        new = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))[: len(k)]
        self.number = np.cumsum(new) - 1  # of each sorted row
        self.first = self.rows[new]
        self.key = key[self.first]

    def texts(self, table: pa.Table) -> list[bytes]:
        return _raw(table["text"].take(pa.array(self.first)))


def collapsed(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each slice, equal for equal slices: by 128 bits."""
    held = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    a = mixed(size.astype(np.uint64))
    b = a.copy()
    for at in range(0, int(size.max(initial=0)), 8):
        live = np.flatnonzero(size > at)
        left = np.minimum(8, size[live] - at).astype(np.uint64) * np.uint64(8)
        word = held[start[live] + at] << (np.uint64(64) - left)
        a[live] = mixed(a[live] ^ word)
        b[live] = mixed((b[live] + word) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.lexsort((b, a))
    new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


def _least(number: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The smallest key of all that have this number."""
    least = np.full(number.max(initial=-1) + 1, NO_KEY)
    np.minimum.at(least, number, key)
    return least[number]


def _stretch_rows(shards: int, length: int) -> Callable:
    """Of a chunk, by shard: the stretches in shared buckets; spans that the chunk itself decides pass through."""

    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return pa.Table.from_batches([_packed([])])
        shared = np.unique(_joined(told, "a", "<u8"))
        chunk = docs["chunk"][0].as_py()
        own = _Chunk(docs)
        found, blobs, base = [], [], 0
        for begin, texts in _slices(own.texts(docs)):
            text_of, first, count, bucket = stretches(texts, length)
            bucket = numbered(bucket, shards)
            at = np.minimum(np.searchsorted(shared, bucket), len(shared) - 1)
            use = np.flatnonzero(shared[at] == bucket)
            size = np.array([len(t) for t in texts])
            start = (np.cumsum(size) - size)[text_of[use]] + first[use]
            cut, ends = ragged(np.frombuffer(b"".join(texts), np.uint8), start, count[use] + length - 1)
            found.append((text_of[use] + begin, first[use], count[use], bucket[use], ends[:-1] + base))
            blobs.append(cut.tobytes())
            base += len(blobs[-1])
        doc, first, count, bucket, start = map(np.concatenate, zip(*found))
        raw = b"".join(blobs)
        key = own.key[doc]
        later = key > _least(collapsed(raw, start, count + length - 1), key)
        rows = [(chunk % shards, chunk, doc[later].astype(np.uint32), first[later].astype(np.uint32), (first + count + length - 1)[later].astype(np.uint32))] if later.any() else []
        held = np.flatnonzero(~later)
        blob = np.frombuffer(raw, np.uint8)
        for s, i in _split(shard_of(bucket[held]), held):
            rows.append((s, chunk, None, doc[i].astype(np.uint32), first[i].astype(np.uint32), count[i].astype(np.uint8), key[i], ragged(blob, start[i], count[i] + length - 1)[0]))
        return pa.Table.from_batches([_packed(rows)])

    return send


def _spans(length: int) -> Callable:
    """(chunk, a, b, c): of a shard, by chunk: document, start and end of what smaller keys have too."""

    def decide(table: pa.Table) -> pa.Table:
        mine = np.array([x is not None for x in table["f"].to_pylist()], bool)
        passed = table.filter(pa.array(~mine)).select(["chunk", "a", "b", "c"])
        table = table.filter(pa.array(mine))
        doc, first, count, key = (_joined(table, c, k) for c, k in zip("bcde", ("<u4", "<u4", "u1", "<i8")))
        raw = b"".join(_arrays(table, "f"))
        count = count.astype(np.int64)
        size = count + length - 1
        start = np.cumsum(size) - size
        chunk = np.repeat(table["chunk"].to_numpy(), [len(x) for x in _arrays(table, "d")])
        number = collapsed(raw, start, size)
        least = _least(number, key)
        later = key > least
        _, alone = np.unique(number, return_index=True)  # one stretch for all equal ones
        cut, at = ragged(np.frombuffer(raw, np.uint8), start[alone], size[alone])
        of = np.repeat(np.arange(len(alone)), count[alone])  # of each suffix: its stretch
        step = np.arange(len(of)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
        order, head = same_start(cut.tobytes(), at[:-1][of] + step, length)
        least = least[alone]
        smallest = np.empty(len(of), np.int64)
        if len(of):
            begin = np.flatnonzero(head)
            smallest[order] = np.repeat(np.minimum.reduceat(least[of[order]], begin), np.diff(np.append(begin, len(order))))
        hit = smallest < least[of]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))  # a run may go on in the next stretch
        a, b = edge[::2], edge[1::2] - 1
        begin, end, owner = [], [], []
        if len(a):
            parts = of[b] - of[a] + 1
            which = np.repeat(np.arange(len(a)), parts)
            owner = of[a][which] + np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            base = np.cumsum(count[alone]) - count[alone]
            begin, end = np.maximum(a[which], base[owner]) - base[owner], np.minimum(b[which], base[owner] + count[alone][owner] - 1) - base[owner]
        # what a stretch has, every equal one of the same smallest key has
        runs = np.bincount(np.asarray(owner, np.int64), minlength=len(alone))
        at = np.cumsum(runs) - runs
        keepers = np.flatnonzero(~later)
        n = runs[number[keepers]]
        pick = np.repeat(at[number[keepers]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who = np.repeat(keepers, n)
        begin, end = np.asarray(begin, np.int64)[pick], np.asarray(end, np.int64)[pick]
        whole = np.flatnonzero(later)
        row = np.concatenate([who, whole])
        left = first[row] + np.concatenate([begin, np.zeros(len(whole), np.int64)])
        right = first[row] + np.concatenate([end, count[whole] - 1]) + length
        rows = [(-1, c, *arrays) for c, *arrays in _split(chunk[row], doc[row], left.astype(np.uint32), right.astype(np.uint32))]
        return pa.concat_tables([passed, pa.Table.from_batches([_packed(rows)]).select(["chunk", "a", "b", "c"])])

    return decide


def whole_characters(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans, ascending and apart, widened to whole characters of UTF-8; those that then meet are one."""
    within = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)  # not the first byte of a character
    for _ in range(3):
        start, end = start - within[start], end + within[end]
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


def _cut(names: list[str], schema: pa.Schema, as_text: bool) -> Callable:
    """The rows of a chunk with what is left of their bytes; ``as_text``: in their text."""

    def cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        own = _Chunk(docs)
        doc, start, end = (_joined(spans, c, "<u4").astype(np.int64) for c in "abc")
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        kept, counts = own.texts(docs), np.zeros((len(own.first), 3), np.int64)
        counts[:, 0] = [len(t) for t in kept]
        if len(doc):
            reach = np.maximum.accumulate(doc * (1 << 40) + end)  # spans that touch are one
            new = np.append(True, doc[1:] * (1 << 40) + start[1:] > reach[:-1])
            head = np.flatnonzero(new)
            a, b, d = start[head], np.maximum.reduceat(end, head), doc[head]
            for i, p, q in _split(d, a, b):
                text = kept[i]
                if as_text:
                    p, q = whole_characters(text, p, q)
                counts[i, 1:] = (q - p).sum(), len(p)
                edge = [0, *np.stack([p, q], 1).ravel().tolist(), len(text)]
                kept[i] = b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2]))
        number = pa.array(own.number)
        rows = docs.take(pa.array(own.rows)).select(names)
        more = [pa.array(kept, pa.binary()).take(number), *(pa.array(counts[:, i]).take(number) for i in range(3))]
        if as_text:
            left = pa.array([t.decode() for t in kept], pa.string()).take(number)
            rows = rows.set_column(names.index("text"), "text", pa.compute.if_else(rows["text"].is_null(), None, left))
        return pa.Table.from_arrays([*rows.columns, *more], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return cut


def _releasing(make: Callable) -> Callable:
    """``make``, before which memory that was freed goes back; for one table or two."""
    if make.__code__.co_argcount == 2:

        def two(left: pa.Table, right: pa.Table) -> pa.Table:
            release_memory()
            return make(left, right)

        return two

    def one(table: pa.Table) -> pa.Table:
        release_memory()
        return make(table)

    return one


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, as_text: bool = False, name: str = "suffix_dedup") -> DataFrame:
    """``docs`` and a struct column ``name``: kept (bytes), n_bytes, n_removed, n_spans.

    Removed is every byte covered by a string of ``length`` bytes that also
    starts in a row with a smaller key.  Texts count as UTF-8, a null one as
    empty; strings don't cross rows and are judged on the input.  A null key is
    larger than any other; rows that share a key, or have none, don't count
    against each other.  Repeated rows get equal results; an empty table gives
    an empty result.  ``docs`` keeps its columns, whatever their names, but a
    column ``name`` is replaced.  Keys are integers; a key that can't be cast to
    one is an error.

    ``as_text``: what is left also replaces the text, a null one stays null;
    characters that a span cuts in two are removed whole, and counted.
    """
    columns = [c for c in docs.columns if c != name]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    tag = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    number = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY))
    chunk = F.pmod(F.xxhash64(number, tag), F.lit(groups)).cast("int")
    plain = docs.select(chunk.alias("chunk"), number.alias("key"), tag.alias("tag"), F.col(text).alias("text"))
    posted = plain.select("chunk", "key", "text").mapInArrow(_postings(groups, length), PACKED)
    since = tables()
    told = written(posted.groupBy("shard").applyInArrow(_releasing(_shared), "chunk int, a binary"), "shared", free=True)
    sent = plain.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_releasing(_stretch_rows(groups, length)), PACKED)
    spans = written(sent.groupBy("shard").applyInArrow(_releasing(_spans(length)), "chunk int, a binary, b binary, c binary"), "spans", free=True)
    discard(docs.sparkSession, since, ("spans",))
    names = [f"_{i}" for i in range(len(columns))]
    kept_names = ["text" if c == text else n for c, n in zip(columns, names)]
    rest = [F.col(c).alias(n) for c, n in zip(columns, names) if c != text]
    result = docs.select(chunk.alias("chunk"), number.alias("key"), tag.alias("tag"), F.col(text).alias("text"), *rest)
    schema = result.select(*kept_names).schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    out = result.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_releasing(_cut(kept_names, to_arrow_schema(schema), as_text)), schema)
    back = [F.col(n).alias(c) for c, n in zip(columns, kept_names)]
    return out.select(*back, F.struct("kept", "n_bytes", "n_removed", "n_spans").alias(name))
