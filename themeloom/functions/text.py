"""Column expressions that turn raw text into word arrays. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, limits and thresholds that results depend on.
# (?U) gives \s and \d their Unicode meaning, so a no-break space counts as white space.
CASE_NUMBER = r"(?U)No\.?\s*\d{1,6}(?:[-–]\d{1,6})?"
REPORTER_CITE = r"(?U)U\.?S\.?\s*\d+"
PETITION_HEADER = r"(?siU)^.*?(JOINT\s+PETITION\s+FOR\s+A\s+WRIT\s+OF\s+CERTIORARI)"
MAX_CHARS = 5_000_000
MIN_WORD_LENGTH = 3
MAX_WORD_LENGTH = 15
MIN_TOKENS = 5
CHUNK_WORDS = 100

_WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def truncate_text(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """The first ``max_chars`` characters of a text."""
    return F.substring(text, 1, max_chars)


def strip_case_numbers(text: Column) -> Column:
    """Remove docket numbers such as ``No. 12-345``."""
    return F.regexp_replace(text, CASE_NUMBER, "")


def strip_reporter_cites(text: Column) -> Column:
    """Remove reporter citations such as ``U.S. 410``."""
    return F.regexp_replace(text, REPORTER_CITE, "")


def strip_petition_header(text: Column) -> Column:
    """Remove everything up to and including the first petition header."""
    return F.regexp_replace(text, PETITION_HEADER, "")


def clean_boilerplate(text: Column) -> Column:
    """Docket numbers, citations and header, removed in this order."""
    return strip_petition_header(strip_reporter_cites(strip_case_numbers(text)))


def letters_only(text: Column) -> Column:
    """One space for every character outside A-Z and a-z, then lower case."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z]", " "))


def words_of(
    text: Column, min_length: int = MIN_WORD_LENGTH, max_length: int = MAX_WORD_LENGTH
) -> Column:
    """Lower-case words in text order, duplicates kept.

    Runs of other characters act as one separator. Words outside the length bounds are left out.
    """
    spaced = F.lower(F.regexp_replace(text, "[^A-Za-z]+", " "))
    return F.filter(F.split(spaced, " "), lambda word: F.length(word).between(min_length, max_length))


def sql_list(words: Iterable[str]) -> str:
    """Quoted words for an SQL ``IN``. Spark tests membership by hash.

    As text, a long list becomes part of the plan in one step instead of one call per word.
    """
    quoted = (word.replace("\\", "\\\\").replace("'", "\\'") for word in words)
    return ", ".join(f"'{word}'" for word in quoted)


def without_words(tokens: str, words: Iterable[str]) -> Column:
    """Drop words from an array column; order and duplicates of the others stay."""
    listed = sql_list(words)
    return F.expr(f"filter({tokens}, word -> word NOT IN ({listed}))") if listed else F.col(tokens)


def has_enough_tokens(tokens: Column, minimum: int = MIN_TOKENS) -> Column:
    return F.size(tokens) >= minimum


def text_chunks(text: Column, words_per_chunk: int = CHUNK_WORDS) -> Column:
    """Array of consecutive chunks; the last may be short and blank text gives none."""
    every_word = F.filter(F.split(text, _WHITE_SPACE), lambda word: word != "")

    def chunks(words: Column) -> Column:
        last = F.ceil(F.size(words) / F.lit(words_per_chunk)).cast("int") - 1
        numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            numbers,
            lambda i: F.array_join(F.slice(words, i * words_per_chunk + 1, F.lit(words_per_chunk)), " "),
        )

    # The outer transform binds the words, so the text is split once and not once per chunk.
    return F.get(F.transform(F.array(every_word), chunks), 0)
