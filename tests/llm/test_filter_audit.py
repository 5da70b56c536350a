"""The filter audit against plain application of the filters in every order."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm.filter_audit import audited_documents, swaps

SCHEMA = "doc_id bigint, text string, source string, mask int, first string"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n) == 1 + len(list(swaps(n)))


def fails(docs):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, part in docs:
        text = text or ""
        words = WORD.findall(text)
        hit = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        out.append((i, part or "", {k for k, v in hit.items() if v}))
    return out


def plain(docs, labels):
    good, toxic = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))
    found, out, shapley = fails(docs), {}, Counter()
    for part in {p for _, p, _ in found}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in found if p == part]
            whole = list(left)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                redundant = sum(name in f for _, f in whole) - len(gone)
                left = [(i, f) for i, f in left if name not in f]
                unique = sum(f == {name} for _, f in whole)
                out[part, order, step] = (len(left), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, name] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def documents():
    rng = random.Random(4)
    prose = lambda n, some=400: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randrange(some)) for _ in range(n))
    out = [None, "", " \t\n ", "AAA BBB", prose(50), prose(49), prose(100, 2), "Ü" + prose(60) + " 5% of it", "X" * 400 + " " + prose(80), "日本 語 " * 30, "word " * 5000, "a\x0bb\x0cc " * 20]
    for _ in range(150):
        text = prose(rng.randint(20, 80), rng.choice([9, 400]))
        out.append(rng.choice([text, text, text.upper(), text + " #", rng.choice(out)]))
    docs = [(i, t, rng.choice(["web", "news", None, ""])) for i, t in enumerate(out)]
    docs += [(None, out[5], "web"), (None, None, "only nulls"), (3, "AAA BBB", "web"), (7, "AAA BBB", "news")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_plain_filters(spark):
    docs, labels = documents()
    table = spark.createDataFrame([(*d, 9, "z") for d in docs], SCHEMA).repartition(3)
    got = audited_documents(table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()}
    assert rows == plain(docs, labels) and len(rows) == got.count()


def test_audit_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited_documents(none, labels).count() == 0
    docs = spark.createDataFrame([(1, "x", "a", 0, "")], SCHEMA)
    assert audited_documents(docs, labels).count() == 600
