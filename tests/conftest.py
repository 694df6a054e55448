import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from themeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "8g")


@pytest.fixture
def docs_of(spark):
    """Documents from lists of tokens, numbered from 0."""

    def build(*token_lists):
        rows = [(i, list(tokens)) for i, tokens in enumerate(token_lists)]
        return spark.createDataFrame(rows, "doc_id long, tokens array<string>")

    return build


@pytest.fixture
def tokens_of():
    """doc_id -> token list."""

    def collect(docs):
        return {row.doc_id: list(row.tokens) for row in docs.collect()}

    return collect
