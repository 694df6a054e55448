from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import quality as ql

SCHEMA = "doc_id long, text string, lang string, source string, _x0 double"
TEXTS = ["", None, "a", "a b c d e a b c d e", "x\nx\n\n \nx y\nx", "é ü\tß #*$%&|<>\n", "one two three four five six one two three four five",
         "w " * 40, "line\r\nline\r\nother", "A b C d E a b c d e", "\n", "end\n", "q\x0bq\x0cq"]


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[ \t-\r]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_counts_equal_plain_python(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS * 3)]
    out = ql.text_counts(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    got = {r.doc_id: tuple(r[1:]) for r in out}
    assert got == {i: brute(text) for i, text in rows}


def test_slices_do_not_matter():
    from themeloom.llm.shared import hashed_texts

    texts = pa.array(TEXTS * 2)
    one = np.concatenate([p.words for p in hashed_texts(texts)])
    many = np.concatenate([p.words for p in hashed_texts(texts, most_bytes=1)])
    assert one.tolist() == many.tolist()


def test_chi_square():
    assert ql.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert ql.chi_square_cdf(12.5916, 6) == pytest.approx(0.95, abs=1e-4)


def test_outliers_go_and_regular_rows_stay(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = []
    for i in range(240):
        text = " ".join(word(rng.integers(3, 8)) for _ in range(60))
        rows.append((i, text, "en" if i % 2 else None, f"s{i % 3}", 1.0))
    for i in range(240, 248):
        rows.append((i, " ".join(word(5) + "$$$" for _ in range(60)), "en", "s1", 1.0))
    rows += [(300, None, None, None, 1.0), (301, "short", "en", "s1", 1.0), (1, rows[1][1], "en", "s1", 1.0)]
    out = ql.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(240)) and not any(kept[i] for i in range(240, 248))
    assert not kept[300] and not kept[301]
    assert all(r.base_failed == (r.n_words < 10) for r in out)


def test_concentration_finds_the_centre_of_most_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal([5, 0, 0, 0], [0.1, 0.01, 0.1, 0.05], (400, 4))
    bad = rng.normal([9, 2, 2, 1], 0.1, (80, 4))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([good, bad])], "_group string, _x0 double, _x1 double, _x2 double, _x3 double")
    mean = ql.minimum_covariance(rows).first()._mean
    assert np.allclose(mean, [5, 0, 0, 0], atol=0.05)


def steps(x, start, least, mean):
    """Concentration steps over one group in plain numpy, with the operator's levels of distance."""
    grow = ql.NEAREST / ql.chi_square_cdf(ql.chi_square_quantile(ql.NEAREST, 4), 6)
    inverse, best = np.linalg.inv(start), None
    while True:
        off = x - mean
        level = np.floor(np.log2(np.maximum(np.einsum("ni,ij,nj->n", off, inverse, off), 2.0**-20)) * ql.BINS_PER_OCTAVE)
        limit = np.sort(level)[int(np.ceil(ql.NEAREST * len(x))) - 1]
        near = x[level <= limit]
        mean = near.mean(axis=0)
        scatter = grow * np.cov(near.T, bias=True) + np.diag(np.square(least))
        found = (np.linalg.slogdet(scatter)[1], mean, scatter)
        if best is not None and found[0] >= best[0] - ql.LEAST_GAIN:
            return best
        best, inverse = found, np.linalg.inv(scatter)


def plain_starts(x, least):
    middle = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) / 2)) - 1]
    centre = middle(x)
    scale = np.sqrt((1.4826 * middle(np.abs(x - centre))) ** 2 + np.square(least))
    z = (x - centre) / scale
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    sphere = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    shapes = [np.cov(np.tanh(z).T, bias=True), sphere.T @ sphere / len(z)]
    shapes = [shape * 4 / np.trace(shape) for shape in shapes]
    return centre, [np.diag(scale**2), *(np.outer(scale, scale) * shape + np.diag(np.square(least)) for shape in shapes)]


def test_estimates_equal_plain_steps_of_least_determinant(spark):
    rng = np.random.default_rng(11)
    least = (0.05, 0.03, 0.25, 0.05)
    groups = {}
    for g in range(4):
        turn = rng.normal(0, 1, (4, 4))
        good = rng.normal(0, 1, (150, 4)) @ turn + 3
        bad = rng.normal(0, 0.3, (35, 4)) + rng.normal(0, 1, 4) @ turn * (2 + g)
        groups[f"g{g}"] = np.vstack([good, bad])
    groups["flat"] = np.column_stack([rng.normal(5, 0.1, 90), np.zeros((90, 2)), np.r_[np.zeros(80), np.full(10, 0.4)]])
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    frame = spark.createDataFrame(rows, "_group string, _x0 double, _x1 double, _x2 double, _x3 double").repartition(5)
    got = {r._group: r for r in ql.minimum_covariance(frame, least).collect()}
    for g, x in groups.items():
        centre, begin = plain_starts(x, least)
        found = [steps(x, start, least, centre) for start in begin]
        best = min(found, key=lambda f: f[0])
        assert got[g]._log_det == pytest.approx(best[0], abs=1e-5)
        assert min(np.abs(np.array(got[g]._mean) - f[1]).max() for f in found if f[0] < best[0] + 1e-5) < 1e-5
        # random starts hardly ever do better
        lucky = [steps(x, np.eye(4), least, x[rng.integers(len(x))])[0] for _ in range(30)]
        assert got[g]._log_det <= np.median(lucky) + 1e-6


def test_floors_come_from_the_whole_table(spark):
    rng = np.random.default_rng(5)
    schema = "n_words long, _x0 double, _x1 double, _x2 double, _x3 double"
    x = rng.normal(5, 2, 501)
    wide = ql.floors(spark.createDataFrame([(300, float(v), 0.0, 0.0, 0.0) for v in x], schema))
    bound = np.sqrt(ql.chi_square_quantile(1 - ql.REJECTED, 4))
    assert wide[0] == pytest.approx(0.25 * 1.4826 * np.median(np.abs(x - np.median(x))), rel=0.02)
    assert wide[3] == pytest.approx(np.sqrt(2 * 20 / 400) / bound)
    # a text of more than a few hundred words with a fifth of them repeated can be rejected for that alone
    assert all(np.sqrt(0.2 * n / (n + 100)) > bound * wide[3] for n in (300, 5000))
    assert len(ql.floors(spark.createDataFrame([], schema))) == 4


def test_repeated_words_alone_reject_and_single_signs_do_not(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(text(200)), "en", "s", 1.0) for i in range(150)]
    passage = text(55)
    rows += [(200, " ".join([*text(200), *passage, *text(200), *passage, *text(90)]), "en", "s", 1.0)]
    rows += [(201, " ".join([*text(90), *passage[:5], *text(90), *passage[:5]]), "en", "s", 1.0)]
    rows += [(202, " ".join(text(100)) + "\n" + " ".join(passage[:9]) + " &\n" + " ".join(text(90) + passage[:9]), "en", "s", 1.0)]
    out = {r.doc_id: r for r in ql.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[200].n_repeat_words == 110 and not out[200].base_failed and not out[200].kept
    assert all(out[i].kept for i in (*range(150), 201, 202))


def test_no_rows_and_only_failing_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0.0)], SCHEMA)
    assert ql.quality_verdicts(docs.limit(0)).count() == 0
    assert [(r.kept, r.distance) for r in ql.quality_verdicts(docs).collect()] == [(False, None)]
