"""The text operators against plain versions of themselves, on small tables with the odd cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import jaccard, language, media, quality, suffix_dedup, suffixes, toxicity
from tidemark.llm.bpe_ops import bpe_decode, bpe_encode, bpe_round_trip
from tidemark.llm.components import connected
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard import jaccard_components, near_dedup
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.media import describe_media, from_png, media_columns, padded, to_png
from tidemark.llm.packing import best_fit, openers, pack_documents, sweep, swept
from tidemark.llm.words import subwords

WORDS = "alpha beta gamma delta wind tide mark stone river cloud light, Dark. élan über ñandú 日本 l'eau don't".split(" ")
SCHEMA = "doc_id bigint, text string, lang string, chunk int, `_0` string"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage, out = prose(30), [None, "", " \n\t ", "a", "Hi there", "aaaa " * 200, prose(3000)]
    base = prose(120).split(" ")
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(prose(rng.randint(1, 150)))
        elif kind == 1:
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edit%d" % i
            out.append(" ".join(copy))
        elif kind == 2:
            out.append(f"{prose(8)} {passage} {prose(8)}")
        elif kind == 3:
            out.append("one line\ntwo lines\nthree lines\n" + prose(5) + "\nfour")
        else:
            out.append(out[rng.randrange(len(out))])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], 7, "x") for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, plain, empty):
    got = {r.doc_id: r for r in media_columns(docs).collect()}
    for i, text in plain.items():
        payload = padded(text.encode())
        r = got[i]
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text.encode()), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(to_png(payload)).hexdigest() and r.media_bytes == len(to_png(payload))
        assert from_png(to_png(payload)).tobytes() == payload
    assert media_columns(empty).count() == 0


def test_media_of_lasting_damage_fails(tmp_path, spark, docs):
    stored = media.store_media(docs, f"file://{tmp_path}/m")
    assert describe_media(stored).count() == docs.count()
    archive = next(tmp_path.glob("m/*.zip"))
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(bytes(data))
    with pytest.raises(Exception, match="not whole"):
        stored.count() and describe_media(stored).collect()


def test_media_append_and_overwrite(tmp_path, spark):
    path = f"file://{tmp_path}/m"
    some = lambda ids: spark.createDataFrame([(i, "text") for i in ids], "doc_id bigint, text string")
    keys = lambda stored: sorted(r.key for r in stored.select("key").collect())
    assert keys(media.store_media(some([1, 2]), path)) == [1, 2]
    assert keys(media.store_media(some([3]), path)) == [1, 2, 3]
    assert keys(media.store_media(some([4]), path, mode="overwrite")) == [4]
    left = {name for name, _ in media.archives(*media._files(path))}
    assert {f.name for f in tmp_path.glob("m/*.zip")} == left
    writer = media.MediaWriter(path, 1 << 20, False)
    made = writer.write(iter([pa.RecordBatch.from_pydict({"key": [9], "n_bytes": [1], "media": [b"x"]})]))
    assert (tmp_path / "m" / made.made[0][0]).exists()
    writer.abort([made, None])
    assert not (tmp_path / "m" / made.made[0][0]).exists()


class _Faulty:
    """Files of which the reads named by number fail once; ``spoil``: bytes of that read are wrong instead."""

    def __init__(self, files, fail=(), spoil=()):
        self.files, self.fail, self.spoil, self.reads = files, set(fail), set(spoil), 0

    def open_input_file(self, path):
        outer, f = self, self.files.open_input_file(path)

        class Wrapped:
            closed = False
            seek, tell, close = f.seek, f.tell, f.close
            seekable = readable = lambda self: True
            __enter__, __exit__ = lambda self: self, lambda self, *_: f.close()

            def read(self, *n):
                outer.reads += 1
                if outer.reads in outer.fail:
                    raise OSError("a fault that goes away")
                data = f.read(*n)
                return bytes(len(data)) if outer.reads in outer.spoil else data

        return Wrapped()

    def __getattr__(self, name):
        return getattr(self.files, name)


def test_media_reads_again_after_faults_that_go_away(tmp_path, spark, monkeypatch):
    path = f"file://{tmp_path}/m"
    media.store_media(spark.createDataFrame([(i, f"text {i}" * 9) for i in range(5)], "doc_id bigint, text string").coalesce(1), path)
    reader = media.MediaReader(path, 1 << 20, 3)
    (part,) = reader.partitions()
    whole = [r for b in reader.read(part) for r in b.to_pylist()]
    files, root = media._files(path)
    counted = _Faulty(files)
    monkeypatch.setattr(media, "_files", lambda _: (counted, root))
    list(reader.read(part))
    assert len(whole) == 5 and counted.reads >= 2
    for n in range(1, counted.reads + 1):
        for kind in ("fail", "spoil"):
            faulty = _Faulty(files, **{kind: [n]})
            monkeypatch.setattr(media, "_files", lambda _, faulty=faulty: (faulty, root))
            assert [r for b in reader.read(part) for r in b.to_pylist()] == whole, (n, kind)


def test_packing(docs, plain, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in plain.items()}
    rows = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=128).collect()
    cover, places = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = ids[r.doc_id][r.start : r.start + r.length]
        assert len(mine) == r.length and zlib.crc32(np.array(mine, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 128
        cover[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, mine in ids.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(cover[i])):
            assert (piece, start) == (k, at)
            at += length
        assert at == len(mine)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(map(len, ids.values()))
    assert len(places) <= 1.1 * total / 128 + 1
    assert pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_odd_sizes(spark):
    items = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 99), (5, 10), (6, 1), (7, 9)], "item bigint, size bigint")
    got = {r.item: r for r in best_fit(items, 10).collect()}
    assert sorted(got) == [1, 5, 6, 7] and len({r.sequence for r in got.values()}) == 3


def test_sweep_takes_the_largest_that_fits():
    assert sweep([(3, 0, 2), (5, 2, 1)], [(4, 100, 1), (6, 101, 1)]) == [(3, 1, 1, 4, 100, 1, 1), (5, 2, 1, 6, 101, 1, 1)]


def test_sweep_by_ranges_equals_the_whole_sweep(spark):
    rng = np.random.default_rng(3)
    kinds = "value bigint, at bigint, n bigint"
    for capacity, values, most in ((1024, 60, 9), (1024, 1000, 300), (7, 7, 40)):
        items, gaps = (sorted((int(v), 1000 * k, int(rng.integers(1, most))) for k, v in enumerate(rng.integers(1, capacity + 1, values))) for _ in range(2))
        got = swept(spark.createDataFrame(items, kinds), spark.createDataFrame(gaps, kinds), capacity)
        assert sorted(map(tuple, got.collect())) == sorted(sweep(items, gaps))
    none = spark.createDataFrame([], kinds)
    assert swept(none, none, 10).count() == swept(spark.createDataFrame([(5, 0, 1)], kinds), none, 10).count() == 0


def test_openers_are_the_largest(spark):
    rows = spark.createDataFrame([(3, 0), (3, 1), (2, 2), (3, 1 << 33), (1, 9)], "size bigint, at bigint")
    runs = spark.createDataFrame([(3, 0, 2), (2, 2, 1), (3, 1 << 33, 1), (1, 9, 1)], "value bigint, at bigint, n bigint")
    assert {tuple(r) for r in rows.filter(openers(runs, 4, 8)).collect()} == {(3, 1), (3, 1 << 33)}  # 12 in sequences of 8
    assert {r.size for r in rows.filter(openers(runs, 2, 5)).collect()} == {3}


def test_best_fit_needs_about_what_best_fit_decreasing_needs(spark):
    rng = np.random.default_rng(5)
    sizes = [int(v) for v in np.concatenate([rng.integers(1, 100, 400), np.full(200, 34)])]
    got = best_fit(spark.createDataFrame(list(enumerate(sizes)), "item bigint, size bigint").repartition(3), 100).collect()
    loads = defaultdict(int)
    for r in got:
        loads[r.sequence] += sizes[r.item]
    assert sorted(r.item for r in got) == list(range(len(sizes))) and max(loads.values()) <= 100
    plain_loads = []
    for size in sorted(sizes, reverse=True):  # one by one, largest first, to the smallest gap
        fits = [k for k, load in enumerate(plain_loads) if load + size <= 100]
        if fits:
            plain_loads[max(fits, key=plain_loads.__getitem__)] += size
        else:
            plain_loads.append(size)
    assert len(loads) <= len(plain_loads) + 2


def test_bpe(docs, plain, empty):
    ranks_path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = docs.union(docs.sparkSession.createDataFrame([(1000, "it's 'REs ''ll   x\n\n  y　z １２ ǅ́ <|endoftext|> \U0001f600‍'", None, 1, "")], SCHEMA))
    expected = {r.doc_id: own.encode_ordinary(r.text or "") for r in odd.collect()}
    for r in bpe_round_trip(odd, ranks_path).collect():
        ids = expected[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode_bytes(ids)).hexdigest()
    back = bpe_decode(bpe_encode(docs, ranks_path), ranks_path)
    assert {r.doc_id: bytes(r.raw) for r in back.collect()} == {i: t.encode() for i, t in plain.items()}
    assert bpe_round_trip(empty, ranks_path).count() == 0


def removed(plain, keys, length=50):
    seen, out = {}, {}
    for i, t in plain.items():
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            seen[s] = min(seen.get(s, keys[i]), keys[i])
    for i, t in plain.items():
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] < keys[i]:
                gone[p : p + length] = True
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("group", [8 << 20, 2000])
def test_suffix_dedup(docs, plain, empty, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    out = suffix_dedup.suffix_dedup(docs)
    assert out.columns == [*docs.columns, "suffix_dedup"]
    expected = removed(plain, {i: i for i in plain})
    got = {r.doc_id: r.suffix_dedup for r in out.collect()}
    assert {i: (s.n_bytes, s.n_removed, s.n_spans, bytes(s.kept)) for i, s in got.items()} == expected
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_shared_and_null_keys(spark):
    t = "the quick brown fox jumps over the lazy dog, and then it sleeps until noon."
    rows = spark.createDataFrame([(5, t), (5, t + "!"), (None, t), (None, "x" + t), (7, t), (7, t)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 99, r.suffix_dedup.n_removed) for r in suffix_dedup.suffix_dedup(rows).collect())
    n = len(t)
    assert got == [(5, 0), (5, 0), (7, n), (7, n), (99, n), (99, n)]


def test_same_start_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    raw = bytes(rng.integers(97, 99, 400).astype(np.uint8)) * 4 + b"a" * 300
    places = np.arange(len(raw) - 50)
    for block in (16, 1 << 18):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        order, head = suffixes.same_start(raw, places, 50)
        groups = np.split(places[order], np.flatnonzero(head)[1:])
        assert all(len({raw[p : p + 50] for p in g}) == 1 for g in groups)
        assert len(groups) == len({raw[p : p + 50] for p in places})
    assert (suffixes.shifts() >= 0).all()


def test_language(spark, empty):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "with", "house"], "de": ["der", "schon", "nicht", "haus"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(60) for k in [["en", "de"][i % 2]]]
    rows += [(100, None, "en"), (101, "12 34 !", "de"), (102, "the thing", None)]
    got = {r.doc_id: r for r in language.language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.values())
    assert language.language(empty).count() == 0


def test_context_tree_is_method_c():
    tree = language.ContextTree.grown([b"abab"])
    grams = language.grams(np.frombuffer(b"abab", np.uint8))
    bits = tree.bits(grams[-1:])
    assert bits[0] == pytest.approx(-np.log2(1 / 2))  # "aba" was seen once, with one symbol
    fresh = tree.bits(np.array([int.from_bytes(b"abac", "big")], np.uint32))
    # escapes from aba (1 of 2), ba (1 of 2), a (1 of 3) and from no context (2 of 6), then a uniform byte
    assert fresh[0] == pytest.approx(-np.log2(1 / 2) - np.log2(1 / 2) - np.log2(1 / 3) - np.log2(2 / 6) + 8)


def test_language_equals_plain_matching():
    rng = random.Random(3)
    rows = [("".join(rng.choice(letters) for _ in range(80)), name) for name, letters in (("x", "abcab "), ("y", "abdé "), ("z", "dea ")) for _ in range(5)]
    model = language.Languages(rows)
    found = model.code_lengths(["abca bde", "é", "", "q" * 5])

    def bits(text, name):
        seen = defaultdict(Counter)
        for t in (t for t, own in rows if own == name):
            raw = bytes(3) + t.encode()
            for i in range(3, len(raw)):
                for order in range(4):
                    seen[order, raw[i - order : i]][raw[i]] += 1
        total, raw = 0.0, bytes(3) + text.encode()
        for i in range(3, len(raw)):
            for order in (3, 2, 1, 0):
                counts = seen[order, raw[i - order : i]]
                n, d = sum(counts.values()), len(counts)
                if raw[i] in counts:
                    total -= np.log2(counts[raw[i]] / (n + d))
                    break
                if n:
                    total -= np.log2(d / (n + d))
            else:
                total += 8
        return total

    want = [[bits(t, name) for name in "xyz"] for t in ("abca bde", "é", "", "q" * 5)]
    assert found == pytest.approx(np.array(want), rel=1e-5)


def test_columns_of_any_name_pass(spark):
    rows = spark.createDataFrame([(1, "the wind", "a", True, 2.0), (2, None, None, None, None)], "doc_id bigint, text string, _letters string, letters boolean, _row double")
    model = language.Languages([("the wind", "en")])
    found = language.identify(rows, model)
    assert found.columns == [*rows.columns, "lang_pred", "score"]
    assert [tuple(r)[2:6] for r in found.orderBy("doc_id").collect()] == [("a", True, 2.0, "en"), (None, None, None, "und")]
    toxic = toxicity.fit([("vile", 1), ("calm", 0)] * 6)
    good = quality.fit([("vile", 1), ("calm", 0)] * 6)
    for scored in (toxicity.score_toxicity(rows, toxic), quality.score_quality(rows, good)):
        assert scored.columns[:5] == rows.columns and scored.count() == 2
        assert scored.limit(0).count() == 0


def test_line_dedup(docs, plain, empty):
    lines = {i: t.split("\n") for i, t in plain.items()}
    first, cut = {}, defaultdict(set)
    for i in sorted(lines):
        for p in range(len(lines[i]) - 2):
            if first.setdefault(tuple(lines[i][p : p + 3]), (i, p)) != (i, p):
                cut[i] |= {p, p + 1, p + 2}
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    for i in lines:
        assert (got[i].text or "") == "\n".join(x for p, x in enumerate(lines[i]) if p not in cut[i])
    assert line_dedup(empty).count() == 0


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, plain, empty, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: shingles(t) for i, t in plain.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, size=size, percent=percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    if size == 5:
        assert {r.doc_id for r in near_dedup(docs).collect()} == {i for i in sets if find(i) == i}
    assert jaccard_components(empty).count() == 0


def test_near_dedup_shared_and_null_keys(spark):
    rng = random.Random(8)
    prose = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    a, b, c, d, e, f = (" ".join(prose[i : i + 60]) for i in range(0, 360, 60))
    rows = [
        (1, a), (None, a), (None, b),  # a keyless copy goes, the text linked with nothing stays
        (2, c), (3, c + " more"), (3, d),  # so under a shared key
        (None, e), (None, e), (None, e + " more"),  # one row of keyless copies
        (4, f), (4, f), (4, f + " more"), (5, f),  # one row of a key
        (None, None), (None, ""), (4, " "),  # without words
    ]
    expected = [(1, [a]), (None, [b]), (2, [c]), (3, [d]), (None, [e, e + " more"]), (4, [f, f + " more"]), (None, [None]), (None, [""]), (4, [" "])]
    out = near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert out.columns == ["doc_id", "text"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(expected)
    assert all(sum(k == key and t in texts for k, t in got) == 1 for key, texts in expected)


def test_connected(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50, 60: 60}


def test_exact_dedup(docs, plain, empty):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for i, t in plain.items():
        groups[fold(t)].append(i)
    for max_bits in (1 << 28, 64):
        for r in exact_dedup(docs, max_bits=max_bits).collect():
            mine = groups[fold(plain[r.doc_id])]
            assert (r.keep_id, r.group_size, r.kept) == (max(mine), len(mine), r.doc_id == max(mine))
            assert r.text_sha256 == hashlib.sha256(fold(plain[r.doc_id]).encode()).hexdigest()
    assert exact_dedup(empty).count() == 0


def test_classifiers_learn(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad, junk = i % 3 == 0, i % 4 == 0
        words = [rng.choice(["calm", "river", "stone", "meadow", "cloud"]) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["vileword", "v1leword", "vilewords"])
        if junk:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for found, label in ((toxicity.toxicity(docs, truth), "toxic"), (quality.quality(docs, truth), "quality")):
        got = found.join(truth, "doc_id", "left").collect()
        held = [r for r in got if r.held_out and r[label] is not None]
        assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert sum(r.predicted == r[label] for r in held) >= 0.9 * len(held)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(docs, none).count() == quality.quality(docs, none).count() == 242


def test_toxicity_equals_plain_scores():
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))) + (" Vile" if i % 2 else ""), i % 2) for i in range(60)]
    model = toxicity.fit(rows, steps=3)

    def margin(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        value = [model.weight[subwords([w.encode()], toxicity.SIZES, toxicity.BUCKETS)[0]].mean(dtype=np.float64) for w in words]
        passages = [np.mean(value[i : i + toxicity.RUN]) + model.bias for i in range(0, len(value), toxicity.RUN)]
        return np.log(np.mean(np.exp(passages))) if passages else model.bias

    some = [t for t, _ in rows] + ["", " \n "]
    assert model.margins(some) == pytest.approx([margin(t) for t in some], rel=1e-4, abs=1e-4)


def test_quality_equals_plain_scores():
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 300))) + "%%%" * (i % 2), i % 2) for i in range(40)]
    model = quality.fit(rows, steps=5)
    w1, b1, v, u, a, w2, b2 = model.parameters

    def score(text):
        x, _ = quality.passages([text])
        h = [np.tanh((row - model.mean) / model.scale @ w1 + b1) for row in x]
        e = np.array([np.exp((np.tanh(p @ v) / (1 + np.exp(-(p @ u)))) @ a) for p in h])
        bag = sum((s * p for s, p in zip(e / e.sum(), h)), np.zeros(len(b1))) if len(h) else np.zeros(len(b1))
        return 1 / (1 + np.exp(-(bag @ w2 + b2[0])))

    some = [t for t, _ in rows] + [""]
    assert model.scores(some) == pytest.approx([score(t) for t in some], rel=1e-4, abs=1e-5)


def test_texts_beyond_a_chunk(spark):
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(300_000))
    texts_ = {1: long, 2: "short one", 3: None, 4: long + " and more", 5: "short one"}
    docs = spark.createDataFrame(list(texts_.items()), "doc_id bigint, text string").coalesce(1)
    assert len(long) > 3 << 20
    raw = {i: (t or "").encode() for i, t in texts_.items()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for r in bpe_round_trip(docs, path).collect():
        assert r.decoded_sha256 == hashlib.sha256(raw[r.doc_id]).hexdigest()
    for r in media_columns(docs).collect():
        assert r.n_bytes == len(raw[r.doc_id]) and r.payload_sha256 == hashlib.sha256(padded(raw[r.doc_id])).hexdigest()
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}
    removed_ = {r.doc_id: r.suffix_dedup.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert removed_[1] == removed_[2] == removed_[3] == removed_[5] == 0 and removed_[4] >= len(long.encode())
    assert {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()} == {1: 1, 2: 5, 3: 3, 4: 4, 5: 5}
    assert sum(r.length for r in pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).filter("doc_id = 1").collect()) > 600_000
    assert line_dedup(docs).count() == 5


def test_cut_characters_go_whole(spark):
    rows = {1: "é" * 40, 2: "one ũ" + "é" * 30 + "å two"}  # ũ ends with the same byte as é, å begins with the same
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), as_text=True).collect()}
    assert (out[1].text, out[2].text) == (rows[1], "one  two")
    assert tuple(out[2].suffix_dedup)[1:] == (len(rows[2].encode()), 64, 1)
    start, end = suffix_dedup.whole_characters("aé日b".encode(), np.array([2, 4]), np.array([4, 5]))
    assert (start.tolist(), end.tolist()) == ([1], [6])


@pytest.mark.parametrize("block", [40])
def test_jaccard_in_blocks(spark, monkeypatch, block):
    """Trees that are cut into blocks, and those too wide for bitmaps, find the same components."""
    rng = random.Random(13)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(60)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    whole = sorted(map(tuple, jaccard_components(docs, size=2, percent=85).collect()))
    assert 1 < len({c for _, _, c in whole}) < 90
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TREE_ROWS", block // 10)
    assert sorted(map(tuple, jaccard_components(docs, size=2, percent=85).collect())) == whole


def test_toxicity_averages_words_and_passages():
    rng = random.Random(6)
    calm = [f"calm{a}{b}" for a in "aeiou" for b in "lmnrst"]
    rows = []
    for i in range(200):  # toxic where two words stand in one passage, each of which clean texts have too
        words = [rng.choice(calm) for _ in range(64)]
        words[20] = ["zyxquor", "wvujpek"][i % 4 // 2]
        if i % 2:
            words[20:22] = ["zyxquor", "wvujpek"]
        rows.append((" ".join(words), i % 2))
    model = toxicity.fit(rows[:150])
    predicted = model.scores([t for t, _ in rows[150:]]) >= 0.5
    assert np.mean(predicted == [y for _, y in rows[150:]]) >= 0.9
    a, b = rows[0][0], rows[1][0]
    of_a, of_b, of_both = model.margins([a, b, f"{a} {b}"])
    assert of_both == pytest.approx(np.log((np.exp(of_a) + np.exp(of_b)) / 2)) and of_both < max(of_a, of_b)


def test_pipeline_of_an_empty_table(spark, tmp_path, empty):
    import corpus_pipeline

    empty.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    docs.withColumn("n_chars", F.length("text").cast("bigint")).drop("chunk", "_0").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == names, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.pack(spark, kept, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["toxicity", "line_dedup", "ngram_jaccard", "suffix_dedup", "best_fit_packing"]'
