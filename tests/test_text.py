import pytest
from pyspark.sql import functions as F

from themeloom.functions import stopwords as sw
from themeloom.functions import text as tx


def applied(spark, step, value):
    row = spark.createDataFrame([(value,)], "text string").select(step(F.col("text")).alias("out")).first()
    return row.out


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("No. 12-345 filed", " filed"),
        ("No 7–8", ""),
        ("No. 1234567", "7"),
        ("No. 5 x", " x"),
        ("no. 5", "no. 5"),
    ],
)
def test_case_numbers(spark, text, cleaned):
    assert applied(spark, tx.strip_case_numbers, text) == cleaned


@pytest.mark.parametrize("text, cleaned", [("U.S. 410 x", " x"), ("US 5", ""), ("U.S.C.", "U.S.C.")])
def test_reporter_cites(spark, text, cleaned):
    assert applied(spark, tx.strip_reporter_cites, text) == cleaned


def test_header_goes_with_all_text_before_it(spark):
    text = "cover\npage Joint Petition\n for  a WRIT of certiorari body\nJOINT PETITION FOR A WRIT OF CERTIORARI end"
    assert (
        applied(spark, tx.strip_petition_header, text)
        == " body\nJOINT PETITION FOR A WRIT OF CERTIORARI end"
    )
    assert applied(spark, tx.strip_petition_header, "no header") == "no header"


def test_letters_only_keeps_length(spark):
    assert applied(spark, tx.letters_only, "Café, 12 \U0001f600X") == "caf" + " " * 7 + "x"
    # The Kelvin sign is not a letter of the English alphabet although it has a lower-case k.
    assert applied(spark, tx.letters_only, "aKb") == "a b"


def test_word_length_bounds_and_duplicates(spark):
    text = "ab abc " + "x" * 15 + " " + "y" * 16 + " ABC abc"
    assert applied(spark, tx.words_of, text) == ["abc", "x" * 15, "abc", "abc"]
    assert applied(spark, tx.words_of, "") == []


def test_stop_words_keep_order_and_duplicates(spark, docs_of, tokens_of):
    docs = docs_of(["x", "x", "the", "y", "it's", "back\\slash"])
    kept = docs.withColumn("tokens", tx.without_words("tokens", ["the", "it's", "back\\slash"]))
    assert tokens_of(kept) == {0: ["x", "x", "y"]}
    assert tokens_of(docs.withColumn("tokens", tx.without_words("tokens", [])))[0][2] == "the"


@pytest.mark.parametrize("n, sizes", [(0, []), (99, [99]), (100, [100]), (101, [100, 1]), (200, [100, 100])])
def test_chunk_edges(spark, n, sizes):
    words = [f"w{i}" for i in range(n)]
    chunks = applied(spark, tx.text_chunks, "  " + " \n".join(words) + " ")
    assert [len(chunk.split(" ")) for chunk in chunks] == sizes
    assert " ".join(chunks).split() == words


def test_truncation_is_optional_and_counts_characters(spark):
    assert applied(spark, lambda c: tx.truncate_text(c, 3), "é\U0001f600cd") == "é\U0001f600c"


def test_stop_lists():
    words = sw.default_stop_words(["palm"])
    assert {"the", "court", "writs", "parties", "hereunder", "may", "palm"} <= set(words)
    assert len(words) == len(set(words))


def test_word_list_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("york\n\n palm \nyork\n")
    assert sw.read_word_list(spark, str(tmp_path / "words.txt")) == ["palm", "york"]
