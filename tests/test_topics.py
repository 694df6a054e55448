import datetime

from themeloom.operators import topics


def vectors(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, vector array<double>")


def test_dominant_topic(spark):
    rows = topics.dominant_topics(vectors(spark, [0.4, 0.4, 0.2], [0.1, 0.2, 0.7], [0.0, 0.0, 0.0])).collect()
    assert {r.doc_id: (r.topic, r.prob) for r in rows} == {0: (0, 0.4), 1: (2, 0.7), 2: (-1, 0.0)}


def test_sparse_topics(spark):
    rows = topics.sparse_topics(vectors(spark, [0.009, 0.01, 0.981])).collect()
    assert [(r.topic, r.prob) for r in rows] == [(1, 0.01), (2, 0.981)]


def test_wide_and_single(spark):
    long = spark.createDataFrame(
        [(1, 14, 3, 0.5), (1, 17, 5, 0.6), (2, 14, 0, 0.7), (2, 17, 5, 0.8)], "doc_id long, k int, topic int, prob double"
    )
    wide = topics.wide_assignments(long, (14, 17))
    assert wide.columns == ["doc_id", "topic_k14", "topic_k14_prob", "topic_k17", "topic_k17_prob"]
    assert topics.topic_columns(wide.columns + ["my_topic_k15", "topic_k"]) == {14: "topic_k14", 17: "topic_k17"}
    one = topics.single_assignment(wide, 14)
    assert sorted(map(tuple, one.collect())) == [(1, 3, 0.5), (2, 0, 0.7)]
    assert one.columns == ["doc_id", "topic", "topic_prob"]
    shared = topics.topic_agreement(wide, 14, 17).collect()
    assert {tuple(r) for r in shared} == {(3, 5, 1), (0, 5, 1)}
    assert {tuple(r) for r in topics.topic_sizes(long.filter("k = 17")).collect()} == {(5, 2)}


def test_top_words_and_lines(spark):
    rows = [(0, "b", 0.3), (0, "a", 0.3), (0, "c", 0.4), (1, "z", 1.0)]
    words = topics.top_words(spark.createDataFrame(rows, "topic int, term string, weight double"), 2)
    lines = {r.line for r in topics.topic_lines(words).collect()}
    assert lines == {"Topic 0: c, a", "Topic 1: z"}


def test_trend(spark):
    day = datetime.date
    rows = [(1, 0, day(1999, 1, 5)), (2, 0, day(1999, 7, 1)), (3, 1, day(2000, 2, 2))]
    trend = topics.topic_trend(spark.createDataFrame(rows, "doc_id long, topic int, filed date"), "filed")
    assert {tuple(r) for r in trend.collect()} == {(day(1999, 1, 1), 0, 2), (day(2000, 1, 1), 1, 1)}
