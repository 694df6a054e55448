import hashlib
import re
from collections import defaultdict

import pytest

from themeloom.llm import linededup as ld

SCHEMA = "doc_id long, text string, _doc int, _Keep string, n_lines_ int"
LONG = "This line is long enough to be shared by many"
OTHER = "Another line that is long enough, ÄÖÜ and more of it"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line).strip(" \t\n\x0b\x0c\r")


def brute(rows, least_documents=5):
    held = defaultdict(set)
    for key, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                held[key_of(line)].add(-1 if key is None else key)
    out = []
    for key, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -1 if key is None else key
        kept = [x for x in lines if len(held[key_of(x)]) < least_documents or own == max(held[key_of(x)])]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((key, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=str)


def rows_of(spark, rows, **options):
    out = ld.line_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def sample():
    rows = [(i, f"head {i}\n {LONG.upper()}\t\r\n{OTHER if i % 2 else 'x'}\n{LONG}", 1, "k", 2) for i in range(12)]
    rows += [(3, f"{LONG}\nsame key, other text", 1, "k", 2), (None, LONG, 1, "k", 2), (None, LONG, 1, "k", 2)]
    rows += [(20, None, 1, "k", 2), (21, "", 1, "k", 2), (22, "\n\n", 1, "k", 2)]
    rows += [(30 + i, "\n".join(f"line {i} {j}" for j in range(200)) + f"\n{OTHER}\n" + "end", 1, "k", 2) for i in range(3)]
    return rows + rows[:2]


@pytest.mark.parametrize("hot_part", [1, 16, 4096])
def test_lines_shared_by_many_documents_go(spark, hot_part):
    rows = sample()
    assert rows_of(spark, rows, hot_part=hot_part) == brute(rows)


def test_rows_of_one_key_count_as_one_document(spark):
    rows = [(i % 4, f"{i}\n{LONG}", 1, "k", 2) for i in range(12)]
    assert all(n == 0 for _, _, n, _ in rows_of(spark, rows))
    assert rows_of(spark, rows, least_documents=4) == brute(rows, 4)


def test_bitmaps_hold_only_words_with_cleared_bits(spark):
    text = "\n".join("short" for _ in range(200)) + f"\n{LONG}\nend"
    docs = spark.createDataFrame([(i, text, 1, "k", 2) for i in range(5)], SCHEMA)
    maps = {r.doc_id: r for r in ld.keep_bitmaps(docs).collect()}
    assert sorted(maps) == [0, 1, 2, 3]
    assert [(w.word, w.bits) for w in maps[0].keep] == [(3, ~(1 << 8))] and maps[0].n_dropped == 1
    assert maps[0].text_md5 == hashlib.md5(text.encode()).hexdigest()


def test_columns_pass_through_and_null_texts_stay(spark):
    out = ld.without_shared_lines(spark.createDataFrame(sample(), SCHEMA))
    assert out.columns == ["doc_id", "text", "_doc", "_Keep", "n_lines_"]
    assert [r.text for r in out.where("doc_id = 20").collect()] == [None]
    assert {tuple(r)[2:] for r in out.collect()} == {(1, "k", 2)}


def test_a_text_of_a_hundred_thousand_lines(spark):
    text = "\n".join(LONG if i % 1000 == 7 else f"line {i}" for i in range(100_000))
    rows = [(i, LONG, 1, "k", 2) for i in range(1, 6)] + [(0, text, 1, "k", 2)]
    assert rows_of(spark, rows) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 1, "k", 2)], SCHEMA).limit(0)
    assert ld.line_digests(docs).count() == 0 and ld.keep_bitmaps(docs).count() == 0


def test_no_python_worker_on_the_way(spark):
    plan = ld.line_digests(spark.createDataFrame(sample(), SCHEMA).repartition(2))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
