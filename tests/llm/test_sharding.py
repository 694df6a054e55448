from themeloom.llm.sharding import interleaved_shards

SCHEMA = "doc_id long, text string, source string, shard int, _hash string"


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small", 9, "x") for i in range(400)]
    rows += [(None, None, None, 9, "x"), (5, "", "small", 9, "x"), (5, "", "small", 9, "x")]
    out = interleaved_shards(spark.createDataFrame(rows, SCHEMA), n_shards=7).collect()
    assert len(out) == len(rows)
    for shard in range(7):
        here = [r for r in out if r.shard == shard]
        assert sorted(r.slot for r in here) == list(range(len(here)))
        assert len(rows) // 7 <= len(here) <= len(rows) // 7 + 1
        big = sum(r.source == "big" for r in here)
        assert abs(big - 266 / 7) <= 2
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}


def test_same_rows_in_another_order_give_the_same_shards(spark):
    rows = [(i, f"t{i}", f"s{i % 5}", 0, "") for i in range(60)]
    one = interleaved_shards(spark.createDataFrame(rows, SCHEMA))
    other = interleaved_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))
    assert sorted(one.collect()) == sorted(other.collect())


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a", "b", 0, "")], SCHEMA)
    assert [(r.shard, r.slot) for r in interleaved_shards(few).collect()] == [(0, 0)]
    assert interleaved_shards(few.limit(0)).count() == 0
