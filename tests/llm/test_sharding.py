"""Shards: every row once and whole, counts at most one apart, slots without gaps, the same again."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm.sharding import sharded_documents, write_shards

SCHEMA = "doc_id bigint, text string, bucket int, `row` string, shard string"


def rows(n=500):
    rng = random.Random(2)
    out = [(i, rng.choice([None, "", "short", "ü" * rng.randrange(300), "long " * 3000])) for i in range(n)]
    return out + [(None, None)] * 20 + [(7, "same")] * 300


def table(spark, some, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in some], SCHEMA).repartition(parts)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 5000}, {"bucket_rows": 10, "shards": 5}])
def test_shards_are_whole_and_even(spark, tmp_path, options):
    some = rows()
    got = write_shards(table(spark, some), f"file://{tmp_path}/s", **options).collect()
    assert Counter((r.doc_id, r.text, r.bucket, r.row) for r in got) == Counter((*r, 1, "x") for r in some)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(options.get("shards", 8)))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_buckets_are_bounded_though_a_third_of_the_rows_is_one_row(spark):
    from tidemark.llm.sharding import scattered

    spread = scattered(table(spark, [(1, "same")] * 2000 + [(i, "t") for i in range(4000)]), 60, 6000, "doc_id", "text", 1)
    counts = [r["count"] for r in spread.groupBy("bucket").count().collect()]
    assert sum(counts) == 6000 and max(counts) < 4 * 100


def test_shards_are_the_same_for_any_partitions_and_differ_by_seed(spark, tmp_path):
    some = [(i, f"text {i % 50}") for i in range(400)]
    places = lambda path, parts, **more: {r.doc_id: (r.shard, r.slot) for r in write_shards(table(spark, some, parts), f"file://{tmp_path}/{path}", bucket_rows=30, **more).collect()}
    one = places("a", 2)
    assert one == places("b", 7)
    assert one != places("c", 2, seed=14)
    # copies and neighbours are spread over all shards
    assert len({s for i, (s, _) in one.items() if i % 50 == 3}) > 3 and len({one[i][0] for i in range(20)}) > 4


def test_described_shards(spark):
    some = rows(60)
    got = sharded_documents(table(spark, some))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    found = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got.collect())
    assert found == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in some)
    assert sharded_documents(table(spark, [])).count() == 0
    assert sharded_documents(table(spark, some[:1])).count() == 1
