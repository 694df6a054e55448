import random

import pytest

from themeloom.operators import phrases as phr
from themeloom.plans import corpus as cp


def model_of(spark, *pairs):
    phrases = spark.createDataFrame([(a, b, 9, 99.0) for a, b in pairs], "a string, b string, n long, score double")
    return phr.PhraseModel(phrases, phrases.select("a", "b", "n"), 9 * len(pairs), 100)


def greedy(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in pairs:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("in_plan, broadcast", [(1_000, 1_000), (0, 1_000), (0, 0)])
def test_merging_equals_a_sequential_scan(spark, docs_of, tokens_of, monkeypatch, in_plan, broadcast):
    monkeypatch.setattr(phr, "IN_PLAN_PHRASES", in_plan)
    monkeypatch.setattr(phr, "BROADCAST_PHRASES", broadcast)
    rng = random.Random(5)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(300)]
    pairs = {("a", "a"), ("a", "b"), ("b", "c"), ("d", "a")}
    merged = tokens_of(phr.apply_phrases(docs_of(*lists), model_of(spark, *pairs)))
    assert merged == {i: greedy(tokens, pairs) for i, tokens in enumerate(lists)}


def test_overlaps(spark, docs_of, tokens_of):
    model = model_of(spark, ("a", "b"), ("b", "c"), ("x", "x"))
    out = tokens_of(phr.apply_phrases(docs_of(["a", "b", "c"], ["x", "x", "x"], ["q"], []), model))
    assert out == {0: ["a_b", "c"], 1: ["x_x", "x"], 2: ["q"], 3: []}


def test_no_phrases_change_nothing(spark, docs_of, tokens_of):
    empty = model_of(spark, ("a", "b"))
    empty = phr.PhraseModel(empty.phrases.limit(0), empty.frequent, 9, 100)
    assert tokens_of(phr.apply_phrases(docs_of(["a", "b"]), empty)) == {0: ["a", "b"]}


def test_score(docs_of):
    lists = [["new", "york"]] * 6 + [["new"]] * 4 + [[f"w{i}", f"v{i}"] for i in range(50)]
    model = phr.learn_phrases(docs_of(*lists), min_count=2, threshold=0.0)
    size = 2 + 100 + 51
    assert model.vocabulary_size == size
    assert model.total_pairs == 56
    (row,) = model.phrases.collect()
    assert (row.a, row.b, row.n) == ("new", "york", 6)
    assert row.score == pytest.approx((6 - 2) / (10 * 6) * size)


def test_threshold_is_exclusive_and_counts_reach_min_count(docs_of):
    lists = [["a", "b"]] * 5
    assert phr.learn_phrases(docs_of(*lists), min_count=5, threshold=0.0).phrases.count() == 0
    assert phr.learn_phrases(docs_of(*lists), min_count=6, threshold=-1.0).phrases.count() == 0


def test_second_pass_finds_four_word_phrases(docs_of, tokens_of):
    filler = [[f"f{i}", f"g{i}", f"h{i}"] for i in range(200)]
    lists = [["a", "b", "c", "d", "tail", "b", "d"]] * 60 + filler
    # (b, c) is as frequent as (a, b), but the scan from the left merges (a, b) first.
    settings = cp.CorpusSettings(stop_words=(), threshold=1.0)
    out = tokens_of(cp.phrase_tokens(docs_of(*lists), settings))
    assert out[0][0] == "a_b_c_d"
    assert out[60] == filler[0]


def test_hot_pairs_do_not_shuffle(spark, docs_of, tokens_of, monkeypatch):
    monkeypatch.setattr(phr, "HOT_SHARE", 4)
    lists = [["hot", "hot"]] * 40 + [["a", "b"], ["c", "d"]] * 5
    docs = docs_of(*lists)
    model = phr.learn_phrases(docs, min_count=2, threshold=0.0)
    in_plan = tokens_of(phr.apply_phrases(docs, model))
    monkeypatch.setattr(phr, "BROADCAST_PHRASES", 0)
    assert tokens_of(phr.apply_phrases(docs, model)) == in_plan
    assert in_plan[40] == ["a_b"]


def test_stop_phrases_can_go_after_merging(docs_of, tokens_of):
    lists = [["a", "b", "x"]] * 60 + [[f"f{i}", f"g{i}"] for i in range(200)]
    settings = cp.CorpusSettings(stop_words=("a_b",), filter_after_phrases=True, threshold=1.0, trigram_min_count=1000)
    assert tokens_of(cp.phrase_tokens(docs_of(*lists), settings))[0] == ["x"]


@pytest.mark.parametrize("in_plan, broadcast", [(1_000, 1_000), (0, 1_000), (0, 0)])
def test_repeated_keys_and_odd_tokens_give_one_answer(spark, monkeypatch, in_plan, broadcast):
    monkeypatch.setattr(phr, "IN_PLAN_PHRASES", in_plan)
    monkeypatch.setattr(phr, "BROADCAST_PHRASES", broadcast)
    rows = [(1, ["a", "b", "c"]), (1, ["c", "a", "b"]), (2, ["x\x01y", "z", "", "b"]), (2, ["x", "y\x01z"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    merged = phr.apply_phrases(docs, model_of(spark, ("a", "b"), ("x", "y\x01z")))
    out = sorted(tuple(row.tokens) for row in merged.collect())
    assert out == [("a_b", "c"), ("c", "a_b"), ("x\x01y", "z", "", "b"), ("x_y\x01z",)]


def test_long_documents_take_time_in_proportion(spark, docs_of):
    import time

    model = model_of(spark, ("a", "b"), ("b", "c"))
    rng = random.Random(3)
    text = [rng.choice("abcd") for _ in range(100_000)]
    start = time.perf_counter()
    merged = phr.apply_phrases(docs_of(text), model).first().tokens
    assert time.perf_counter() - start < 30
    assert merged == greedy(text, {("a", "b"), ("b", "c")})


def test_the_second_pass_reads_what_the_first_merged(docs_of, monkeypatch):
    seen, learn = [], phr.learn_phrases
    monkeypatch.setattr(phr, "learn_phrases", lambda docs, *given: seen.append(docs.inputFiles()) or learn(docs, *given))
    cp.phrase_tokens(docs_of(*[["a", "b", "c"]] * 60), cp.CorpusSettings(stop_words=(), threshold=1.0))
    assert [bool(files) for files in seen] == [False, True]


def test_grams_are_counted_before_they_become_rows(spark, monkeypatch):
    monkeypatch.setattr(phr, "TOKENS_AT_ONCE", 50)
    monkeypatch.setattr(phr, "GRAM_ROWS", 7)
    rng = random.Random(8)
    lists = [[rng.choice(["a", "b", "", "é", None]) for _ in range(rng.randrange(0, 20))] for _ in range(60)]
    docs = spark.createDataFrame([(tokens,) for tokens in [*lists, None]], "tokens array<string>")
    expected = {}
    for tokens in lists:
        for gram in [(t, None) for t in tokens] + list(zip(tokens, tokens[1:])):
            expected[gram] = expected.get(gram, 0) + 1
    counts = phr.gram_counts(docs)
    assert {(row.a, row.b): row.n for row in counts.collect()} == expected
    assert "explode" not in counts._jdf.queryExecution().toString()


def test_many_phrases_are_merged_in_one_pass(spark, monkeypatch):
    rng = random.Random(9)
    lists = [[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 20))] for _ in range(80)] + [None]
    docs = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")
    model = model_of(spark, ("a", "a"), ("a", "b"), ("b", "c"))
    plain = sorted(map(str, phr.apply_phrases(docs, model).collect()))
    monkeypatch.setattr(phr, "IN_PLAN_PHRASES", 0)
    monkeypatch.setattr(phr, "TOKENS_AT_ONCE", 50)
    merged = phr.apply_phrases(docs, model)
    assert sorted(map(str, merged.collect())) == plain
    assert "regexp_replace" not in merged._jdf.queryExecution().toString()
