import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from themeloom.llm import merkle as mk

SCHEMA = "doc_id long, text string, source string, lang string, n_chars int, _key string, _TREE int"


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def encoded(value):
    return b"-" if value is None else f"{len(str(value).encode())}:".encode() + str(value).encode()


def leaf_of(row):
    doc_id, text, source, lang, n_chars, *_ = row
    return digest(b"".join(map(encoded, (doc_id, source, lang, n_chars, text))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def brute(rows):
    held = defaultdict(list)
    for row in rows:
        held[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(held[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for number, source in enumerate(order):
        for place, (_, _, leaf, row) in enumerate(sorted(held[source], key=lambda x: x[:3])):
            now, siblings = leaf, []
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                now = leaf_of((row[0], low, *row[2:]))
            for tree, at in ((trees[source], place), (top, number)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    left, right = run[: at % 16], run[at % 16 + 1 :]
                    siblings += left + right
                    now, at = digest("".join(left) + now + "".join(right)), at // 16
            root = top[-1][0]
            out.append((row[0], leaf, trees[source][-1][0], root, digest("".join(siblings)), now, now == root))
    return sorted(out, key=str)


def rows_of(spark, rows):
    out = mk.verified_documents(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("height", range(1, 7))
def test_every_run_has_a_place_of_its_own(height):
    places = np.concatenate([mk.addresses(height, depth, np.arange(16**depth)) for depth in range(height)])
    assert np.array_equal(np.sort(places), np.arange(mk.runs_of(height)))


@pytest.mark.parametrize("height", range(1, 8))
def test_a_block_is_one_stretch_of_the_layout(height):
    assert sum(mk.strata(height)) == height and max(mk.strata(height)) <= mk.BLOCK_LEVELS
    below = 0
    for levels in mk.strata(height):
        top = height - below - levels
        block = 16**top // 2
        start = int(mk.addresses(height, top, np.array([block]))[0])
        for depth in range(levels):
            inside = np.arange(16**depth)
            own = mk.addresses(levels, depth, inside)
            assert np.array_equal(mk.addresses(height, top + depth, block * 16**depth + inside), start + own)
        below += levels


@pytest.mark.parametrize("block_levels", [1, 2, 3])
def test_roots_and_proofs(spark, monkeypatch, block_levels):
    monkeypatch.setattr(mk, "BLOCK_LEVELS", block_levels)
    monkeypatch.setattr(mk, "_STRATA", [mk.strata(h) for h in range(mk.MOST_LEVELS + 1)])
    rows = [(i, f"Text {i} ÄÖ", "big", "en", i, "k", 1) for i in range(300)]
    rows += [(1000 + i, f"T{i}", f"s{i % 18}", None, None, "k", 1) for i in range(60)]
    rows += [(2000, "Alone", "lone", "de", 5, "k", 1), (None, "X", None, "de", 5, "k", 1), (7, None, None, None, None, "k", 1)]
    rows += [(5, "", "s1", "de", 0, "k", 1), (5, "", "s1", "de", 0, "k", 1), (5, "Other", "s1", "de", 0, "k", 1), (None, "Y", "s1", "", 0, "k", 1)]
    assert rows_of(spark, rows) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(10, "One", "a", "en", 3, "k", 1)]
    assert rows_of(spark, rows) == brute(rows)
    assert mk.verified_documents(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_runs_of_exactly_sixteen_and_one_more(spark):
    for n in (16, 17, 256, 257):
        rows = [(i, f"T {i}", "a", "en", 3, "k", 1) for i in range(n)]
        assert rows_of(spark, rows) == brute(rows)
