import random

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import neardup as nd

SCHEMA = "doc_id long, text string, _node long, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*row, 1, "c") for row in rows], SCHEMA)


def shingles(text, words):
    found = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, similar):
    """Components by comparing all pairs."""
    sets = [(key, shingles(text, words)) for key, text in rows if key is not None]
    parent = {key: key for key, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= similar * len(s | t):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {key: root(key) for key, _ in sets}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 30, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(w.upper() if rng.random() < 0.1 else w for w in copy)))
    return rows


@pytest.mark.parametrize("seed,words,similar", [(1, 3, 85), (2, 5, 80)])
def test_components_equal_all_pairs(spark, seed, words, similar):
    rows = texts(seed) + [(900, None), (901, ""), (902, " \n"), (None, "w1 w2 w3"), (903, "w1 w2 w3"), (904, "w1 w2 w3")]
    out = nd.near_duplicates(docs_of(spark, rows), words, similar).collect()
    assert len(out) == len(rows)
    expected = brute(rows, words, similar)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    sizes = {key: len(shingles(text, words)) for key, text in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in out)


def test_near_misses_of_one_text_are_not_linked(spark):
    """Copies that each differ too much from one another share many buckets and no link but the exact ones."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        copy = list(base)
        for place in rng.sample(range(100), 4 if i % 2 else 1):
            copy[place] = f"x{i}_{place}"
        rows.append((i, " ".join(copy)))
    out = nd.near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows, 3, 85)


def test_shared_keys_and_kept_documents(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "z"), (None, "z"), (4, "z")]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 3, 85).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, None: None}
    left = nd.without_near_duplicates(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 4, None]


def test_signature_fills_every_bin_with_a_member():
    probes = nd.probe_orders()
    one = np.sort(np.array([3, 2**62, 2**63], dtype=np.uint64))
    assert set(nd.signature(one, probes).tolist()) == set(one.tolist())


def test_chain_of_nodes_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "_a long, _b long")
    found = {r._node: r._component for r in nd.components(edges).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_shingles_fold_only_ascii_case():
    sets = [s.tolist() for _, part in nd.shingle_sets(pa.array(["A b c", "a B C", "É b c", "é b c", None]), 3) for s in part]
    assert sets[0] == sets[1] and sets[2] != sets[3] and sets[4] == []


def test_empty_table(spark):
    assert nd.near_duplicates(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
