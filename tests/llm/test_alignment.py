import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from themeloom.llm import alignment as al

SCHEMA = "doc_id long, text string, _row long, n_a string, _pair int"
ODD = [
    "plain words, and Punctuation!", "naïve façade 日本語 テスト 😀👍🏽", "a  b\t\tc\n\n d ", "<|endoftext|> <s> </s> <0x41> <unk>",
    "x" * 300, " lead", "tail ", "▁ piece sign", "é é", "don't we'll I'm", "1234567890 3.14", "\x00\x01 \x7f", "   ", "\n",
]


@cache
def plain_byte():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(al.BYTE_TOKENIZER))
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain_groups(a, b, size_a, size_b):
    """Walk both sides until their ends meet."""
    out, i, j = [], 0, 0
    while i < len(a):
        own, other, end_a, end_b = [a[i]], [b[j]], size_a[a[i]], size_b[b[j]]
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                own.append(a[i])
                end_a += size_a[a[i]]
                i += 1
            else:
                other.append(b[j])
                end_b += size_b[b[j]]
                j += 1
        out.append((own, other))
    return out


def brute(rows):
    both = al.two_tokenizers()
    size_a, size_b = (s.tolist() for s in both.sizes())
    found, counts = [], Counter()
    for key, text, *_ in rows:
        a = plain_byte().encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.piece.encode(text) if text else []
        raw = f" {text}".encode()
        if text and not raw == b"".join(both.byte.tokens[i] for i in a) == b"".join(both.piece_tokens[i] for i in b):
            a, b = [], []
        spans = []
        for ids, sizes in ((a, size_a), (b, size_b)):
            ends = np.cumsum([sizes[i] for i in ids]).tolist()
            spans.append([(e - sizes[i], e, i) for i, e in zip(ids, ends, strict=True)])
        links = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        counts.update(links)
        found.append((key, a, b, plain_groups(a, b, size_a, size_b), links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for key, a, b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        best = sum(counts[pair] == most[pair[1]] for pair in links)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def sample():
    rows = [(i, text, 1, "x", 2) for i, text in enumerate(ODD)]
    rows += [(50, None, 1, "x", 2), (51, "", 1, "x", 2), (None, "some words", 1, "x", 2)]
    return rows + [(60, "Tokenizers disagree about internationalisation.", 1, "x", 2)] * 3


@pytest.mark.parametrize("looked_up", [al.LOOKED_UP, 20, 0])
def test_links_and_counts(spark, looked_up):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = al.aligned_tokens(docs, looked_up=looked_up)
    assert out.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) >= len(ODD) - 2


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "hi", 1, "x", 2)], SCHEMA)
    row = al.aligned_tokens(docs, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") + 1 == row.n_groups


def test_cutting_a_text_into_words_changes_no_id():
    both = al.two_tokenizers()
    for text in (*ODD, "Some Words go on, and on; über alles 日本 語 and 12 34 ab  cd e\n f\t g \x1c h \u00a0 i"):
        words = al.cut_words(text)
        assert words == al.CUT.split(text)
        ((a, _), (b, _)), whole = both.encoded(words)
        assert not whole.all() or a.tolist() == plain_byte().encode(f" {text}", add_special_tokens=False).ids
        if "▁" not in text:
            assert b.tolist() == both.piece.encode(text)


def test_a_text_that_one_tokenizer_changes_counts_nowhere(spark):
    rows = [(1, "same words here", 1, "x", 2), (2, "same words here and a ▁ sign", 1, "x", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, al.aligned_tokens(docs).collect())) == brute(rows)


def test_blocks_of_few_words_give_the_same(spark):
    rows = sample() * 3
    both = al.two_tokenizers()
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["_text"])
    al.WORDS_AT_ONCE, kept = 5, al.WORDS_AT_ONCE
    try:
        blocks = list(al._blocks(iter([batch, batch]), 0))
    finally:
        al.WORDS_AT_ONCE = kept
    assert sum(len(b.places) for b in blocks) == 2 * len(rows)
    for block in blocks:
        table, _, bounds = block.table(both, with_texts=True)
        assert len(table.texts) == len(block.numbers) and len(bounds) == len(block.places) + 1


def test_ranks_give_the_ids_of_the_file_for_every_character():
    ranked, plain = al.ByteTokenizer(public_tokenizers.path(al.BYTE_TOKENIZER)), plain_byte()
    assert ranked.ranked is not None
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0)]
    texts = [f" a{c}b {c} {c}1{c} {c}{c}.{c}'s" for c in characters]
    for start in range(0, len(texts), 4096):
        some = texts[start : start + 4096]
        expected = plain.encode_batch_fast(some, add_special_tokens=False)
        assert ranked.encoded(some) == [e.ids for e in expected]


def test_no_piece_goes_on_over_a_space():
    both = al.two_tokenizers()
    pieces = (both.piece.id_to_piece(i) for i in range(both.piece.get_piece_size()))
    assert not any("▁" in piece.lstrip("▁") for piece in pieces)


def test_a_very_long_text(spark, monkeypatch):
    text = "one long text of many words and " * 20_000
    row = al.aligned_tokens(spark.createDataFrame([(1, text, 1, "x", 2)], SCHEMA)).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 100_000


def test_empty_table(spark):
    docs = spark.createDataFrame(sample(), SCHEMA).limit(0)
    assert al.aligned_tokens(docs).count() == 0
