from themeloom.operators import dictionary as dct


def test_counts_and_top_ties(docs_of):
    docs = docs_of(["b", "a", "b"], ["c", "a"])
    assert {(r.token, r.n) for r in dct.token_counts(docs).collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert [r.token for r in dct.top_tokens(docs, 1).collect()] == ["a"]


def test_counts_per_document(docs_of):
    docs = docs_of(["b", "a", "b", "", "b"], [], ["a"])
    rows = {(r.doc_id, r.token, r.n) for r in dct.document_token_counts(docs).collect()}
    assert rows == {(0, "b", 3), (0, "a", 1), (0, "", 1), (2, "a", 1)}


def test_top_tokens_leave_every_document(docs_of, tokens_of):
    docs = docs_of(["x", "y", "x", "z"], ["x"])
    assert tokens_of(dct.without_top_tokens(docs, dct.top_tokens(docs, 1))) == {0: ["y", "z"], 1: []}


def test_bounds_are_inclusive(docs_of):
    # 70 documents: the upper bound is floor(0.3 * 70) = 21.
    lists = [[] for _ in range(70)]
    for term, df in (("d19", 19), ("d20", 20), ("d21", 21), ("d22", 22)):
        for i in range(df):
            lists[i].append(term)
    terms = dct.build_dictionary(docs_of(*lists)).collect()
    assert sorted((r.term_id, r.term, r.df, r.cf) for r in terms) == [(0, "d21", 21, 21), (1, "d20", 20, 20)]


def test_most_frequent_terms_are_kept_with_ties_by_name(docs_of):
    docs = docs_of(["a", "b", "c"], ["c", "b", "a", "c"], ["c", "z"])
    terms = dct.build_dictionary(docs, no_below=1, no_above=1.0, keep_terms=2).collect()
    assert sorted((r.term_id, r.term, r.df, r.cf) for r in terms) == [(0, "c", 3, 4), (1, "a", 2, 2)]


def test_bag_of_words_and_vectors(docs_of, monkeypatch):
    docs = docs_of(["a", "b", "a"], ["z"], ["b"])
    terms = dct.build_dictionary(docs, no_below=2, no_above=1.0)
    small = {(r.doc_id, r.term_id, r.n) for r in dct.bag_of_words(docs, terms).collect()}
    assert small == {(0, 0, 1), (2, 0, 1)}
    monkeypatch.setattr(dct, "BROADCAST_TERMS", 0)
    assert {(r.doc_id, r.term_id, r.n) for r in dct.bag_of_words(docs, terms).collect()} == small
    vectors = dct.count_vectors(docs, dct.vectoriser(terms)).collect()
    assert {r.doc_id: r.features.toArray().tolist() for r in vectors} == {0: [1.0], 1: [0.0], 2: [1.0]}
    assert dct.token_total(terms) == 2


def test_term_statistics_sort_no_document(docs_of, capsys):
    found = dct.term_statistics(docs_of(["b", "a", "b"], ["b"], []))
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1), ("b", 2, 3)]
    found.explain("extended")
    assert "sort_array" not in capsys.readouterr().out
