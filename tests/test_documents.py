import random

import pytest
from pyspark.sql import functions as F

from themeloom.operators import documents as dox
from themeloom.sources import readers, writers


@pytest.fixture
def texts(spark):
    rows = [
        (1, "alpha beta gamma delta omega", "a"),
        (2, None, "b"),
        (3, "alpha beta gamma delta", "c"),
        (4, "", "d"),
        (5, "alpha " * 7, "e"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, tag string")


def test_null_texts_and_token_floor(texts):
    assert {r.doc_id for r in dox.present_texts(texts).collect()} == {1, 3, 4, 5}
    kept = dox.with_enough_tokens(dox.content_tokens(texts, []))
    assert {r.doc_id for r in kept.collect()} == {1, 5}


def test_null_test_reaches_the_scan(texts, tmp_path, spark):
    texts.write.parquet(str(tmp_path / "t"))
    plan = dox.content_tokens(spark.read.parquet(str(tmp_path / "t")), ["the"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)]" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_chained_filters_evaluate_the_text_once(texts):
    docs = dox.with_enough_tokens(dox.content_tokens(texts, ["the"]))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z]+") == 1


def test_row_index_is_a_total_order_over_many_partitions(spark):
    keys = random.Random(3).sample(range(100_000), 3_000)
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long").repartition(7)
    indexed = dox.with_row_index(rows, ["doc_id"], "i").collect()
    assert [r.doc_id for r in sorted(indexed, key=lambda r: r.i)] == sorted(keys)
    assert sorted(r.i for r in indexed) == list(range(3_000))


def test_row_index_descending_with_ties(spark):
    rows = spark.createDataFrame([(2, "b"), (2, "a"), (9, "z"), (1, "c")], "n int, w string")
    indexed = dox.with_row_index(rows, [F.desc("n"), F.asc("w")], "i").collect()
    assert [r.w for r in sorted(indexed, key=lambda r: r.i)] == ["z", "a", "b", "c"]


def test_index_map(texts):
    original = dox.original_index(texts)
    survivors = dox.with_enough_tokens(dox.content_tokens(texts, []))
    rows = sorted(dox.index_map(original, survivors).collect())
    assert [(r.doc_id, r.original_index, r.final_index) for r in rows] == [(1, 0, 0), (5, 3, 1)]


def test_alignment(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    right = spark.createDataFrame([(2,), (3,)], "doc_id long")
    row = dox.alignment_report(left, right).first()
    assert row.asDict() == {
        "left_rows": 3,
        "right_rows": 2,
        "distinct_keys": 3,
        "missing_right": 1,
        "missing_left": 1,
        "repeated_keys": 1,
        "changed": 0,
    }
    with pytest.raises(ValueError, match="not aligned"):
        dox.require_alignment(left, right)
    dox.require_alignment(right, right)


def test_small_tables_are_spread_and_counts_agree(texts, tmp_path, spark):
    path = str(tmp_path / "t")
    texts.coalesce(1).write.parquet(path)
    read = readers.read_texts(spark, path)
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert readers.row_count(readers.read_documents(spark, path)).first()["rows"] == 5
    assert [r.doc_id for r in readers.preview(texts, 2).collect()] == [1, 2]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 14, 3), (1, 17, 5), (2, 14, 0)], "doc_id long, k int, topic int")
    writers.write_by_topic_count(rows, str(tmp_path / "k"))
    back = spark.read.parquet(str(tmp_path / "k"))
    assert sorted((r.doc_id, r.k, r.topic) for r in back.collect()) == [(1, 14, 3), (1, 17, 5), (2, 14, 0)]
    assert (tmp_path / "k" / "k=14").is_dir()
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["doc_id", "k", "topic"]
    writers.write_table(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_changed_contents_are_counted(spark):
    schema = "doc_id long, text string, note string"
    left = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y"), (4, "d", ""), (4, "e", ""), (5, "f", "")], schema)
    right = spark.createDataFrame([(1, "a", "z"), (2, "c", "x"), (3, "y", None), (4, "e", ""), (4, "d", ""), (6, "f", "")], schema)
    assert dox.alignment_report(left, right, content=("text",)).first().changed == 2  # 2 and 3; 4 in another order
    assert dox.alignment_report(left, right, content=("text", "note")).first().changed == 3
    assert dox.alignment_report(left, right).first().changed == 0
    with pytest.raises(ValueError):
        dox.require_alignment(left.where("doc_id = 2"), right.where("doc_id = 2"), content=("text",))
