"""Subword ids of whole texts by a public tokenizer file, with an encoded-word cache per Python worker.

The tokenizer ends a piece at every white space, so the ids of a text are those of its words in turn.
Words repeat, so each worker encodes a word once and keeps its ids as bytes.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from themeloom.llm.shared import WORD_PATTERN, kept_in_worker

TOKENIZER = "word_bpe_49k.json"
#: Entries per generation of the caches of words and of pieces; a worker holds two generations of each.
CACHED_WORDS, CACHED_PIECES = 150_000, 200_000
#: White space for str.split, but not for the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that are one piece of their own behind a word of plain letters.
MARKS = ".,;:!?*#%&$|"
ENCODED_AT_ONCE = 1000


class _Cache:
    """A dictionary whose oldest entries go: two generations, the younger one is filled."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """Words not yet known; the known ones move to the younger generation."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        new = words.difference(self.young)
        if self.old:
            old = self.old
            moved = [word for word in new if word in old]
            self.young.update(zip(moved, map(old.__getitem__, moved), strict=True))
            new.difference_update(moved)
        return list(new)


class WordTokens:
    """Little-endian unsigned 32-bit ids of words and texts."""

    def __init__(self, path: str, most_words: int = CACHED_WORDS, most_pieces: int = CACHED_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.plain = _Cache(most_words), _Cache(most_pieces)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        words = [
            WORD_PATTERN.findall(text) if any(mark in text for mark in SEPARATORS) else text.split() for text in texts
        ]
        self._learn(set().union(*words))
        known = self.words.young.__getitem__
        return [b"".join(map(known, found)) for found in words]

    def _learn(self, words: set[str]) -> None:
        # a word of plain letters and marks is two pieces, which many words share
        new, parted = self.words.missing(words), []
        young, plain = self.words.young, PLAIN.fullmatch
        for word in new:
            core = word.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or plain(core)):
                parted.append((word, core.lower(), word[len(core) :]))
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                young[word] = np.array(ids, dtype="<u4").tobytes()
        pieces = {core for _, core, _ in parted}
        pieces.update({marks for _, _, marks in parted})
        pieces.discard("")
        self._encode_pieces(self.plain.missing(pieces))
        known = self.plain.young
        known[""] = b""
        for word, core, marks in parted:
            young[word] = known[core] + known[marks] if marks else known[core]

    def _encode_pieces(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), ENCODED_AT_ONCE):
            part = pieces[start : start + ENCODED_AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ids = np.array(encoded, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            raw, before = ids.tobytes(), 0
            for piece, end in zip(part, (last * 4).tolist(), strict=True):
                self.plain.young[piece] = raw[before:end]
                before = end


def word_tokens(path: str | None = None) -> WordTokens:
    """The worker's tokenizer and cache; every node has the tokenizer files at the same place."""
    path = path or public_tokenizers.path(TOKENIZER)
    return kept_in_worker(f"tokens {path}", lambda: WordTokens(path))
