"""Lines that many documents share, marked for removal by a bitmap per document.

Lines travel as hashes with their document and place, never as text. The hashes are range-partitioned and
each range is read in order of hash, document and place, so that the first row of a hash is the occurrence
that stays. What comes back to a document is a compressed bitmap of the lines to keep. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.shared import fresh, text_or_empty
from themeloom.staging import stage

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: A cell of hashes with more than this part of all rows is spread over buckets of at most such a part.
HOT_PART = 4096
CELLS = 1 << 16
WORD_BITS = 6
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``_high, _low`` (128 bits of the key), ``_doc, _digest, _pos`` of every line that may be dropped."""
    folded = docs.select("_doc", "_digest", F.posexplode(_lines(F.translate("_text", UPPER, LOWER))).alias("_pos", "_line"))
    keyed = folded.select("_doc", "_digest", "_pos", F.btrim("_line", F.lit(BLANK)).alias("_key"))
    return keyed.where(F.length("_key") >= least_chars).select(
        F.xxhash64("_key").alias("_high"), F.xxhash64(F.lit("line"), "_key").alias("_low"), "_doc", "_digest", "_pos"
    )


def _streamed(rows: DataFrame) -> DataFrame:
    """Rows with the documents of their hash and bucket, ``_n``, and the largest of these, ``_last``.

    A range holds whole buckets, so that one sort of each range serves; the windows need no further shuffle.
    """
    keys = ["_high", "_low", "_bucket"]
    one = Window.partitionBy(*keys)
    ordered = one.orderBy(F.desc_nulls_last("_doc"), "_pos")
    this = F.struct("_doc")
    first = F.lag(this).over(ordered).eqNullSafe(this)
    marked = rows.repartitionByRange(*keys).withColumn("_first", F.when(first, 0).otherwise(1))
    return marked.withColumn("_n", F.sum("_first").over(one)).withColumn("_last", F.max("_doc").over(one))


def _older(least_documents: int) -> Column:
    # a document without key ranks below all others
    older = F.coalesce(F.col("_doc") < F.col("_last"), F.col("_last").isNotNull())
    return (F.col("_n") >= least_documents) & older


def _dropped(lines: DataFrame, least_documents: int, hot_part: int) -> DataFrame:
    """``_doc, _digest, _pos`` of the lines that go."""
    total = lines.count()
    cell = F.pmod("_high", F.lit(CELLS)).cast("int")
    # at most hot_part rows, whatever the number of lines
    hot = lines.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_rows")).where(F.col("_rows") * hot_part > total)
    hot = hot.select("_cell", F.ceil(F.col("_rows") * hot_part / total).alias("_buckets"))
    spread = lines.withColumn("_cell", cell).join(F.broadcast(hot), "_cell", "left").drop("_cell")
    even = _streamed(spread.where("_buckets IS NULL").withColumn("_bucket", F.lit(0).cast("long")))
    bucket = F.pmod(F.xxhash64("_doc"), "_buckets")
    wide = stage(_streamed(spread.where("_buckets IS NOT NULL").withColumn("_bucket", bucket)), "lines_spread")
    # buckets hold whole documents, so their counts add up; one row per hash and bucket
    key = Window.partitionBy("_high", "_low")
    parts = wide.groupBy("_high", "_low", "_bucket").agg(F.max("_n").alias("_n"), F.max("_last").alias("_last"))
    whole = parts.select(
        "_high", "_low", "_bucket", F.sum("_n").over(key).alias("_n"), F.max("_last").over(key).alias("_last")
    ).where(F.col("_n") >= least_documents)
    judged = wide.drop("_n", "_last").join(whole, ["_high", "_low", "_bucket"])
    columns = ["_doc", "_digest", "_pos"]
    gone = _older(least_documents)
    return even.where(gone).select(*columns).unionByName(judged.where(gone).select(*columns))


def _bitmaps(docs: DataFrame, least_chars: int, least_documents: int, hot_part: int) -> DataFrame:
    lines = stage(_hashed_lines(docs, least_chars), "lines_hashed")
    word = F.shiftright("_pos", WORD_BITS)
    bit = F.expr(f"shiftleft(1L, _pos & {(1 << WORD_BITS) - 1})")
    words = _dropped(lines, least_documents, hot_part).groupBy("_doc", "_digest", word.alias("_word"))
    words = words.agg(F.bit_or(bit).alias("_bits"))
    entry = F.struct(F.col("_word").alias("word"), F.bitwise_not("_bits").alias("bits"))
    return words.groupBy("_doc", "_digest").agg(
        F.sum(F.bit_count("_bits")).cast("long").alias("_n_dropped"), F.array_sort(F.collect_list(entry)).alias("_keep")
    )


def keep_bitmaps(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    key: str = "doc_id",
    text: str = "text",
    hot_part: int = HOT_PART,
) -> DataFrame:
    """Which lines of each document stay: ``key, text_md5, n_dropped, keep``, for documents that lose lines.

    ``keep`` has the 64-bit words of the document's bitmap that are not all ones, as ``word, bits``; bit i of
    word w is line 64 w + i, from 0. Texts are split at each newline. Lines are equal if they are so without
    blanks at both ends and with A-Z as a-z. A line of at least ``least_chars`` characters that at least
    ``least_documents`` documents hold stays only in the largest ``key`` of these, there each time it occurs.

    Rows that repeat a key are one document for counting; ``text_md5`` tells them apart, and rows equal in
    both get one bitmap. A null key is one document that ranks below all others. Null texts are empty: one
    line too short to go. No other column is read; an empty table gives no rows. A hash that holds a large
    part of all lines is spread over buckets of documents, and their counts are added up.
    """
    given = docs.select(F.col(key).alias("_doc"), text_or_empty(text).alias("_text"))
    maps = _bitmaps(given.withColumn("_digest", _digest(F.col("_text"))), least_chars, least_documents, hot_part)
    return maps.select(
        F.col("_doc").alias(key), F.lower(F.hex("_digest")).alias("text_md5"), F.col("_n_dropped").alias("n_dropped"), F.col("_keep").alias("keep")
    )


def _dense(keep: Column) -> Column:
    """Words of the bitmap up to the last that is not all ones."""

    def filled(entry: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), entry["word"] - before - 1), F.array(entry["bits"]))

    return F.flatten(F.transform(keep, filled))


def without_shared_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    key: str = "doc_id",
    text: str = "text",
    hot_part: int = HOT_PART,
    counts: bool = False,
) -> DataFrame:
    """``docs`` with the lines that ``keep_bitmaps`` clears left out of ``text``, the rest joined by newlines.

    With ``counts`` also ``n_lines`` (before) and ``n_dropped``. All columns pass through whatever their
    names, repeated rows each, and null texts stay null. Where the bitmaps are small Spark broadcasts them;
    else the documents meet them in one shuffle.
    """
    names = docs.columns
    doc, digest = fresh("_line_doc", names), fresh("_line_digest", names)
    given = docs.select(F.col(key).alias("_doc"), text_or_empty(text).alias("_text"))
    maps = _bitmaps(given.withColumn("_digest", _digest(F.col("_text"))), least_chars, least_documents, hot_part)
    keep, gone = fresh("_line_keep", names), fresh("_line_gone", names)
    maps = stage(maps, "lines_bitmaps").select(
        F.col("_doc").alias(doc), F.col("_digest").alias(digest), F.col("_keep").alias(keep), F.col("_n_dropped").alias(gone)
    )
    same = docs[key].eqNullSafe(maps[doc]) & (_digest(text_or_empty(docs[text])) == maps[digest])
    joined = docs.join(maps, same, "left")
    words = fresh("_line_words", names)
    joined = joined.withColumn(words, F.when(F.col(keep).isNotNull(), _dense(F.col(keep))))

    def stays(line: Column, i: Column) -> Column:
        at = F.get(F.col(words), F.shiftright(i, WORD_BITS))
        mask = (1 << WORD_BITS) - 1
        return F.coalesce(F.getbit(at, i.bitwiseAND(F.lit(mask))) == 1, F.lit(True))

    kept = F.when(F.col(keep).isNull(), F.col(text)).otherwise(F.array_join(F.filter(_lines(F.col(text)), stays), "\n"))
    added = []
    if counts:
        added = [
            F.size(_lines(text_or_empty(text))).cast("long").alias("n_lines"),
            F.coalesce(gone, F.lit(0).cast("long")).alias("n_dropped"),
        ]
    return joined.select(*(kept.alias(c) if c == text else F.col(c) for c in names), *added)


def line_digests(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    key: str = "doc_id",
    text: str = "text",
    hot_part: int = HOT_PART,
) -> DataFrame:
    """``key, n_lines, n_dropped, kept_sha256`` of each row; a null text counts as empty."""
    left = without_shared_lines(docs.select(key, text), least_chars, least_documents, key, text, hot_part, counts=True)
    return left.select(key, "n_lines", "n_dropped", F.sha2(text_or_empty(text).cast("binary"), 256).alias("kept_sha256"))
