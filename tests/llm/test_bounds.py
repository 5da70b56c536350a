"""Bounds on what is collected, columns that pass, manifests of writes at once."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import media
from tidemark.llm.jaccard import near_dedup
from tidemark.llm.samples import drawn, texts_of


def test_a_key_of_many_rows_gives_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i:04}") for i in range(500)] + [(2, "b"), (2, None), (3, "c")], "doc_id bigint, text string").repartition(4)
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id bigint, toxic int")
    assert texts_of(docs, sample, "doc_id", "text", "toxic") == [("text 0000", 0), ("", 1), ("c", 1)]


def test_texts_of_a_label_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)], "doc_id bigint, text string")
    sample = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = [y for _, y in texts_of(docs, sample, "doc_id", "text", "toxic", most_bytes=750)]
    assert (found.count(0), found.count(1)) == (7, 7)
    assert len(texts_of(docs, sample, "doc_id", "text", "toxic", most_bytes=5)) == 2


def test_a_key_with_two_labels_has_the_smaller(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, toxic int").repartition(3)
    assert sorted(map(tuple, drawn(labels, "doc_id", "toxic", 10).collect())) == [(1, 0), (2, 1)]


NAMES = "doc_id bigint, text string, _text_id string, line_dedup int, suffix_dedup int, _row string, key string, text_id string, `_id` int, row string"


def clashing(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [base, base, f"{base} more", "something else entirely here now", None, ""]
    return spark.createDataFrame([(i, t, f"t{i}", i, i, "r", "k", "i", i, "w") for i, t in enumerate(texts)], NAMES)


def test_near_dedup_keeps_columns_of_any_name(spark):
    docs = clashing(spark)
    got = near_dedup(docs, size=5, percent=80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 5] and {r._text_id for r in got.collect()} == {"t0", "t3", "t4", "t5"}
    both = near_dedup(docs.unionByName(docs), size=5, percent=80)
    assert sorted(r.doc_id for r in both.collect()) == [0, 3, 4, 4, 5, 5]  # texts without words stay


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = clashing(spark)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert {r._text_id for r in got.collect()} <= {f"t{i}" for i in range(6)}


def test_writes_at_once_keep_each_others_archives(tmp_path, spark):
    path = f"file://{tmp_path}/m"
    one = media.store_media(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), path)
    writers = [media.MediaWriter(path, 1 << 20, False) for _ in range(2)]
    batch = lambda k: pa.RecordBatch.from_pydict({"key": [k], "n_bytes": [1], "media": [media.to_png(media.padded(b"x"))]})
    made = [w.write(iter([batch(k)])) for k, w in enumerate(writers, 2)]
    for w, m in zip(writers, made):
        w.commit([m])
    assert len(media.archives(*media._files(path))) == 3
    (tmp_path / "m" / "_writing-0.json").write_text("[[")  # of a writer that was lost
    assert sorted(r.key for r in one.sparkSession.read.format("tidemark_media").load(path).collect()) == [1, 2, 3]
