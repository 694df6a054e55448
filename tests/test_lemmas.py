import pytest

from themeloom.operators import lemmas as lem

TOKENS = ["children", "cases", "glass", "parties", "boxes", "bus", "this", "held", "gas", "ties", "held"]
LEMMAS = ["child", "case", "glass", "party", "box", "bus", "this", "hold", "gas", "tie", "hold"]


def test_default_table_and_rule(docs_of, tokens_of):
    assert tokens_of(lem.lemmatised(docs_of(TOKENS, [])))[0] == LEMMAS
    assert lem.table_worker()(TOKENS) == LEMMAS


def test_rule_can_be_switched_off(docs_of, tokens_of):
    assert tokens_of(lem.lemmatised(docs_of(TOKENS), regular=False))[0][:2] == ["child", "cases"]
    assert tokens_of(lem.lemmatised(docs_of(TOKENS), {}, regular=False))[0] == TOKENS


@pytest.fixture
def table(spark):
    rows = [(form, lemma) for form, lemma in lem.irregular_forms().items()]
    rows += [(f"form{i}", f"lemma{i}") for i in range(3_000)]
    return spark.createDataFrame(rows, "form string, lemma string")


@pytest.mark.parametrize("in_plan, broadcast", [(5_000, 5_000), (10, 5_000), (10, 20)])
def test_a_table_of_any_size_gives_the_same(docs_of, tokens_of, table, monkeypatch, in_plan, broadcast):
    monkeypatch.setattr(lem, "IN_PLAN_FORMS", in_plan)
    monkeypatch.setattr(lem, "BROADCAST_FORMS", broadcast)
    many = [f"form{i}" for i in range(100)]
    out = tokens_of(lem.lemmatised(docs_of(TOKENS, [], many, ["form7", "unseen"]), table))
    assert out == {0: LEMMAS, 1: [], 2: [f"lemma{i}" for i in range(100)], 3: ["lemma7", "unseen"]}


def test_large_mapping(docs_of, tokens_of):
    forms = {f"form{i}": f"lemma{i}" for i in range(1_500)}
    assert tokens_of(lem.lemmatised(docs_of(["form9", "rules"]), forms))[0] == ["lemma9", "rule"]


def test_user_worker_is_made_once_per_task(docs_of, tokens_of):
    def make():
        made = []

        def worker(tokens):
            made.append(1)
            return [f"{token}{len(made)}" for token in tokens]

        return worker

    docs = docs_of(["a", "b"], ["c"], []).coalesce(1)
    assert tokens_of(lem.lemmatised_by(docs, make)) == {0: ["a1", "b1"], 1: ["c2"], 2: []}


PAIRS = {
    "series": "series", "species": "species", "news": "news", "always": "always", "perhaps": "perhaps",
    "texas": "texas", "kansas": "kansas", "thomas": "thomas", "james": "james", "bias": "bias", "alias": "alias",
    "analyses": "analysis", "indices": "index", "goes": "go", "buses": "bus", "viruses": "virus", "causes": "cause",
    "houses": "house", "uses": "use", "excuses": "excuse", "shoes": "shoe", "potatoes": "potato", "statuses": "status",
    "wolves": "wolf", "data": "datum", "physics": "physics", "claims": "claim", "ties": "tie",
}


def test_words_have_their_real_lemmas(docs_of, tokens_of):
    assert tokens_of(lem.lemmatised(docs_of(list(PAIRS))))[0] == list(PAIRS.values())
    assert lem.table_worker()(list(PAIRS)) == list(PAIRS.values())


@pytest.mark.parametrize("in_plan, broadcast", [(5_000, 5_000), (1, 5_000), (0, 0)])
def test_repeated_forms_and_keys_give_one_answer(spark, monkeypatch, in_plan, broadcast):
    monkeypatch.setattr(lem, "IN_PLAN_FORMS", in_plan)
    monkeypatch.setattr(lem, "BROADCAST_FORMS", broadcast)
    forms = spark.createDataFrame([("saw", "see2"), ("saw", "see"), ("was", "be")], "form string, lemma string")
    docs = spark.createDataFrame([(1, ["saw", "x"]), (1, ["x", "was"]), (1, [])], "doc_id long, tokens array<string>")
    out = sorted(tuple(row.tokens) for row in lem.lemmatised(docs, forms).collect())
    assert out == [(), ("see", "x"), ("x", "be")]
