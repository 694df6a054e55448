import random
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from themeloom.llm import packing as pk
from themeloom.llm.tokens import WordTokens

SCHEMA = "doc_id long, text string, length int, _key string"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x1cb c", "İstanbul <|endoftext|>x", "don't 'S a b", "😀zz, (ok)", "", None, "é́ ́y", "Word, word; WORD%%%"]


def fewest(lengths, capacity):
    """Sequences of the best packing, by trying every order with first fit."""
    best = len(lengths)
    for order in set(permutations(lengths)):
        rooms = []
        for length in order:
            at = next((i for i, room in enumerate(rooms) if room >= length), None)
            if at is None:
                rooms.append(capacity - length)
            else:
                rooms[at] -= length
        best = min(best, len(rooms))
    return best


def lower_bound(lengths, capacity):
    """Martello and Toth's bound L2: pieces over half the capacity need a sequence each, and what is between
    must fit into their rooms or into more sequences."""
    best = 0
    for k in range(capacity // 2 + 1):
        large = [x for x in lengths if x > capacity - k]
        middle = [x for x in lengths if capacity / 2 < x <= capacity - k]
        small = [x for x in lengths if k <= x <= capacity / 2]
        room = len(middle) * capacity - sum(middle)
        best = max(best, len(large) + len(middle) + max(0, -((room - sum(small)) // capacity)))
    return best


def counted(lengths):
    return {length: lengths.count(length) for length in set(lengths)}


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(7)]
    fixed, left = pk.dominance_reduction(counted(lengths), 20)
    rest = [length for length, n in left.items() for _ in range(n)]
    assert sum(p.times for p in fixed) + (fewest(rest, 20) if rest else 0) == fewest(lengths, 20)


@pytest.mark.parametrize("seed", range(10))
def test_patterns_hold_every_piece_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 50, 51, 99, 100, rng.randint(1, 100)]) for _ in range(400)]
    patterns = pk.pack_counts(counted(lengths), 100)
    assert all(0 < p.used() <= 100 and p.times > 0 for p in patterns)
    held = {}
    for p in patterns:
        for length, n in p.runs:
            held[length] = held.get(length, 0) + n * p.times
    assert held == counted(lengths)
    assert sum(p.times for p in patterns) <= lower_bound(lengths, 100) + 1


def test_cached_ids_are_the_tokenizer_s():
    plain, cached = Tokenizer.from_file(PATH), WordTokens(PATH, most_words=3, most_pieces=3)
    texts = [t or "" for t in ODD] * 3 + [f"word{i} other, Other." for i in range(50)]
    for text, raw in zip(texts, cached.texts(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    for text in texts:  # the cache has lost most words by now
        assert np.frombuffer(cached.texts([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(spark):
    rows = [(i, text, 1, "k") for i, text in enumerate(ODD)] + [(50, "long words " * 40, 1, "k")] * 2 + [(None, "x", 1, "k")]
    out = pk.packed_pieces(spark.createDataFrame(rows, SCHEMA), capacity=32, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    expected = {i: [*plain.encode(text or "", add_special_tokens=False).ids, 1] for i, text, *_ in rows}
    pieces = {}
    for r in out:
        assert r.length == len(r.ids) <= 32
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for key, parts in pieces.items():
        n = 2 if key == 50 else 1
        ids = [x for _, start, part in sorted(parts)[::n] for x in part]
        assert ids == expected[key]
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 32


def test_empty_table(spark):
    assert pk.packed_pieces(spark.createDataFrame([(1, "a", 1, "k")], SCHEMA).limit(0)).count() == 0
