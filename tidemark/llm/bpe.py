"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Boundaries are found without a regular expression.  Every code point gets a
class, every class (with what follows it) a symbol, every symbol a transition
function over a few states.  Functions compose associatively, so blocks are
composed side by side, a prefix scan over the blocks gives the state in which
each begins, and a second pass marks where tokens may start.  The slices between
the marks are deduplicated within the batch, looked up in a cache, and merged
together in numpy where the cache has none.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re

import numpy as np
import tiktoken

LETTER, NUMBER, OTHER, SPACE = range(4)
#: White_Space of Unicode, which is what \s means to the published pattern (fixed values).
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# symbols: a letter, number or other character; white space that more white space
# or the end follows; a last blank, which joins what follows; another last white
# space; an apostrophe before a suffix of one letter, of two.
SYM_L, SYM_N, SYM_O, SYM_RUN, SYM_BLANK, SYM_LAST, SYM_Q1, SYM_Q2 = range(8)
# states: within letters, numbers, others, white space; after a blank that joins;
# closed; within a suffix with one or two letters to come.
IN_L, IN_N, IN_O, IN_RUN, JOIN, CLOSED, SUFFIX1, SUFFIX2 = range(8)
BLOCK = 64
SPECIAL_BYTES = 64  # longer pieces are merged one by one, with a heap


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode version of the library whose ids count."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        asked = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}+", mergeable_ranks=single, special_tokens={})
        found = bytes(asked.encode_ordinary(every)).decode()  # what doesn't match is left out
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[list(WHITE)] = SPACE
    return table


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """By symbol * 8 + state: the next state, and whether a token starts. Symbols from 8 on begin a text."""
    nxt, new = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, state in ((SYM_L, IN_L), (SYM_N, IN_N), (SYM_O, IN_O), (SYM_RUN, IN_RUN), (SYM_BLANK, JOIN), (SYM_LAST, CLOSED), (SYM_Q1, SUFFIX1), (SYM_Q2, SUFFIX2)):
        nxt[symbol] = state
        if symbol in (SYM_L, SYM_N, SYM_O, SYM_RUN):
            new[symbol, state] = False
        if symbol in (SYM_L, SYM_N, SYM_O):
            new[symbol, JOIN] = False
    for symbol in (SYM_Q1, SYM_Q2):  # within other characters an apostrophe is one of them
        nxt[symbol, [IN_O, JOIN]], new[symbol, [IN_O, JOIN]] = IN_O, False
    nxt[SYM_L, [SUFFIX2, SUFFIX1]], new[SYM_L, [SUFFIX2, SUFFIX1]] = [SUFFIX1, CLOSED], False
    nxt[8:] = nxt[:8, [CLOSED]]
    return nxt.ravel(), new.ravel()


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts that begin at ``starts`` (none is empty)."""
    n = len(points)
    kind = class_table()[points]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[-1:] = True
    follows = np.append(kind[1:], np.uint8(SPACE))
    follows[last] = SPACE
    out = kind.copy()
    space = np.flatnonzero(kind == SPACE)
    out[space] = np.where(follows[space] == SPACE, SYM_RUN, np.where(points[space] == 0x20, SYM_BLANK, SYM_LAST))
    at = np.flatnonzero(points == 0x27)
    at = at[~last[at]]
    if len(at):
        a = points[at + 1]
        two = ~last[at + 1]
        b = np.where(two, points[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[one]] = SYM_Q1
        out[at[two]] = SYM_Q2
    out[starts] += 8
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Where tokens start, by a scan of transition functions."""
    nxt, new = transitions()
    n = len(symbol)
    blocks = -(-n // BLOCK)
    rows = np.zeros(blocks * BLOCK, np.uint8)
    rows[:n] = symbol
    rows = np.ascontiguousarray(rows.reshape(blocks, BLOCK).T) << 3  # a row per place in a block
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)  # f[s, b]: where block b leads from s
    for row in rows:
        f = nxt.take(np.add(row, f, out=f), mode="clip")
    f = np.ascontiguousarray(f.T)
    step = 1
    while step < blocks:  # inclusive prefix composition
        f[step:] = np.take_along_axis(f[step:], f[:-step], 1)
        step *= 2
    state = np.append(np.uint8(CLOSED), f[:-1, CLOSED])
    marks = np.empty((BLOCK, blocks), bool)
    for i, row in enumerate(rows):
        at = row + state
        new.take(at, out=marks[i], mode="clip")
        state = nxt.take(at, mode="clip")
    return np.flatnonzero(marks.T.ravel()[:n])


class Vocabulary:
    """Merges and tokens. ``pairs``: (left id, right id) to (rank, id)."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]], special: dict[str, int], cache_size: int = 200_000):
        self.tokens, self.special, self.cache_size = tokens, special, cache_size
        self.byte_ids = np.array([tokens.index(bytes([b])) for b in range(256)], np.uint32)
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.ids = np.array([i for _, i in pairs.values()], np.uint32)[order]
        self.slots, self.keys = self._hashed(keys[order])
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.append(0, np.cumsum(self.lengths))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: each line a token in base64 and its rank, which is its id."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        tokens = sorted(ranks, key=ranks.get)
        assert [ranks[t] for t in tokens] == list(range(len(tokens)))
        pairs = {(ranks[t[:i]], ranks[t[i:]]): (r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        return cls(tokens, pairs, {})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizer file of byte-level BPE: its vocabulary, merges and special tokens."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        hidden = [b for b in range(256) if b not in shown]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(back[c] for c in t)
        for t, i in special.items():
            tokens[i] = t.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        return cls(tokens, {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}, special)

    def _hashed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressed table over ``keys``: slot to the key's number, or -1."""
        self.bits = max(10, int(len(keys) * 4).bit_length())
        slots = np.full(1 << self.bits, -1, np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = slots[place[left]] < 0
            slots[place[left[free]]] = left[free]  # of those that want one slot the last wins
            left = left[slots[place[left]] != left]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        return slots, keys

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair in the merges, or -1."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        place = self._place(keys)
        out = self.slots[place]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slots[place[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.keys[got] != keys[open_])]
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """One piece by a heap: the lowest rank first, of equal ranks the leftmost."""
        ids = [int(i) for i in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := self.pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.uint32).tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian bytes: all pieces take their next merge together."""
        none = np.int64(1) << 60
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        done_ids, done_word = [], []

        def rated(at: np.ndarray) -> np.ndarray:
            """The number of the pair that begins at ``at``, where it is within one word."""
            out = np.full(len(at), -1, np.int32)
            inner = np.flatnonzero(at + 1 < len(ids))
            inner = inner[word[at[inner] + 1] == word[at[inner]]]
            out[inner] = self.look(ids[at[inner]], ids[at[inner] + 1])
            return out

        pair = rated(np.arange(len(ids)))
        while len(ids):
            rank = np.where(pair >= 0, self.ranks[pair], none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == none, count)
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == np.repeat(best, count)) & ~over)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit
            ids[hit] = self.ids[pair[hit]]
            keep = ~over
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            ids, word, pair = ids[keep], word[keep], pair[keep]
            at = moved[hit]
            pair[at] = rated(at)
            at = at[at > 0] - 1
            pair[at] = rated(at)
        all_ids, all_word = np.concatenate(done_ids), np.concatenate(done_word)
        all_ids = all_ids[np.argsort(all_word, kind="stable")]
        ends = np.append(0, np.cumsum(np.bincount(all_word, minlength=len(pieces)))) * 4
        blob = all_ids.astype("<u4").tobytes()
        return [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def cached(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct pieces."""
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache = self.cache
        found = list(map(cache.get, pieces))
        missing = [p for p, ids in zip(pieces, found) if ids is None]
        if not missing:
            return found
        short = [p for p in missing if len(p) <= SPECIAL_BYTES]
        if short:
            cache.update(zip(short, self.merge(short)))
        for p in missing:
            if len(p) > SPECIAL_BYTES:
                cache[p] = self.merge_long(p)
        return list(map(cache.get, pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more entry ends them).

        Special tokens of the vocabulary are taken as such wherever their string stands.
        """
        cut = [self._split(t) for t in texts] if self.special and any(s in t for s in self.special for t in texts) else None
        if cut is None:
            return self._encode(texts)
        ids, starts = self._encode([p for parts in cut for p in parts[::2]])
        out, ends, k = [], [0], 0
        for parts in cut:
            mine = []
            for i, part in enumerate(parts):
                if i % 2:
                    mine.append(np.array([self.special[part]], np.uint32))
                else:
                    mine.append(ids[starts[k] : starts[k + 1]])
                    k += 1
            out += mine
            ends.append(ends[-1] + sum(map(len, mine)))
        return np.concatenate(out), np.array(ends)

    def _split(self, text: str) -> list[str]:
        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = token_starts(symbols(points, begins[sizes > 0]))
        first = np.searchsorted(at, np.append(begins, len(points)))  # of each text: its first piece
        raw = joined.encode()
        if len(raw) > len(points):
            width = np.append(0, np.cumsum((points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000) + np.int64(1)))
            at = width[at]
        number, pieces = distinct_slices(raw, at)
        found = self.cached(pieces)
        ids = np.frombuffer(b"".join(found), "<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(length) - length
        out, total = ragged(ids, begin[number], length[number])
        return out, total[first]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, and the offset in them at which each begins (one more entry ends them)."""
        return ragged(self.blob, self.offsets[ids], self.lengths[ids])


def ragged(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` put together, and where each begins (one more entry ends them)."""
    total = np.append(0, np.cumsum(length))
    return values[np.repeat(begin - total[:-1], length) + np.arange(total[-1])], total


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def distinct_slices(raw: bytes, starts: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """The slices of ``raw`` (to the next start if no length is given): the number of each, and the distinct ones.

    Slices up to 16 bytes are told apart by two words; the few longer ones in a dict.
    """
    length = np.diff(np.append(starts, len(raw))) if length is None else length
    words = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(24), strides=(1,))
    more = np.clip(length - 8, 0, 8)
    low = words[starts] & _MASKS[np.minimum(length, 8)]
    high = words[np.minimum(starts + 8, len(raw))] & _MASKS[more]
    number = np.empty(len(starts), np.int64)
    short = np.flatnonzero(length <= 16)
    low, high, size = low[short], high[short], length[short].astype(np.uint64)
    mix = (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + size * np.uint64(0x165667B19E3779F9)
    mix ^= mix >> np.uint64(32)
    order = np.argsort(mix)
    a, b, c = low[order], high[order], size[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))[: len(order)]  # two of one mix: numbered apart
    number[short[order]] = np.cumsum(new) - 1
    heads = short[order[new]]
    pieces = [raw[s : s + n] for s, n in zip(starts[heads].tolist(), length[heads].tolist())]
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(length > 16).tolist():
        piece = raw[starts[i] : starts[i] + length[i]]
        if (k := seen.get(piece)) is None:
            k = seen[piece] = len(pieces)
            pieces.append(piece)
        number[i] = k
    return number, pieces


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_ranks(path)
