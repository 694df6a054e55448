import numpy as np
import pytest

from themeloom.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, size long, _row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, 7, "x") for row in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation_is_one_to_one_and_invertible(n):
    image = mx.permuted(np.arange(n), n, 12345)
    assert sorted(image) == list(range(n))
    assert list(mx.permuted(image, n, 12345, inverse=True)) == list(range(n))


def test_targets_share_by_weight_below_twice_the_size():
    assert mx.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mx.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mx.targets([], [], 1.5, 2) == []


def brute_words(words, target, block, seed, source):
    """Slots read one after the other until the target is met."""
    n = -(-words // block)
    taken, slot = 0, 0
    while taken < target:
        turn, place = divmod(slot, n)
        at = int(mx.permuted(np.array([place]), n, mx._key(seed, source, turn))[0])
        size = min(block, words - at * block)
        last = min(size, target - taken)
        taken, slot = taken + size, slot + 1
    return slot, last


@pytest.mark.parametrize("words,block", [(10, 4), (64, 8), (7, 100), (101, 10)])
def test_slots_hold_exactly_the_target(words, block):
    for target in range(1, 2 * words + 1):
        slots, last = mx.slots_needed(words, target, block, 3, 1)
        expected, size = brute_words(words, target, block, 3, 1)
        assert slots == expected
        assert min(last, block) >= size


def test_shard_counts_add_up_and_follow_the_mixture():
    drawn = mx.shard_counts([600, 300, 100], 10, 1)
    assert list(sum(drawn)) == [600, 300, 100]
    assert all(counts.sum() == 100 for counts in drawn)
    assert all(abs(counts[0] - 60) < 25 for counts in drawn)


def test_taken_words_meet_the_targets(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(5 + i % 37)), f"s{i % 3}") for i in range(300)]
    rows += [(1000, None, "s0"), (1001, "", None), (1002, " \t\n", "s1"), (1003, "a b c", None)]
    rows += [(7, "same text", "s2")] * 5
    out = mx.mixed_rows(docs_of(spark, rows), block_words=8).collect()
    assert len(out) == len(rows)
    by_target = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 1, size
    assert sorted(out) == sorted(mx.mixed_rows(docs_of(spark, rows), block_words=8).collect())


def test_mixed_documents_keep_whole_texts_and_all_columns(spark):
    rows = [(i, f"a{i}  b\nc{i} d", f"s{i % 2}") for i in range(20)] + [(99, None, "s0"), (98, "", "s1")]
    docs = docs_of(spark, rows)
    out = mx.mixed_documents(docs, block_words=3)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mx.mixed_rows(docs, block_words=3).collect()}
    got = {}
    texts = {i: text for i, text, _ in rows}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert len(r.text.split()) < 4 or r.text == texts[r.doc_id]
        assert (r.size, r._row) == (7, "x")
    assert got == {i: n for i, n in taken.items() if n}


def test_cut_words_joins_neighbouring_spans():
    spans = [{"_from": 0, "_words": 2}, {"_from": 2, "_words": 1}, {"_from": 4, "_words": 1}]
    assert mx.cut_words(" a  b\tc d e", spans) == "a  b\tc\ne"


def test_empty_table(spark):
    empty = docs_of(spark, [(1, "a", "b")]).limit(0)
    assert mx.mixed_rows(empty).count() == 0
    assert mx.mixed_documents(empty).count() == 0
