"""Toxicity of documents by a linear classifier that must not mind which group a sentence names.

Training sees a bounded, balanced sample of labelled documents as sets of features: words and beginnings
of words, of names of groups only the whole word. Features that mark toxic or clean documents clearly
enough get a weight, and so do the names. Each training text that names groups has counterfactuals, the
same text with other groups in their place, and the squared change of the score is part of the loss.
A name that no training text holds has no weight, so that it changes no score.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.shared import WORD_PATTERN, freed_worker, fresh, text_slices
from themeloom.staging import stage

# Names of groups that are exchanged for one another.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "straight", "lesbian", "transgender", "black", "white",
    "asian", "latino", "african", "european", "american", "mexican", "chinese", "indian", "arab",
    "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews",
    "immigrants", "refugees", "foreigners", "natives", "disabled", "blind", "deaf", "old", "young",
    "frauen", "maenner", "juden", "muslime", "christen", "femmes", "hommes", "juifs", "musulmans",
    "mujeres", "hombres", "judios", "musulmanes",
)
THRESHOLD = 0.7
#: Most labelled documents of each class that training sees.
PER_CLASS = 1500
#: Least standard score of a feature's share in one class against the other.
CLEAR = 4.0
#: Least number of documents of that class that show the feature.
LEAST = 2
PREFIXES = (4, 5, 6)
EDGES = ".,;:!?\"'()[]*#%&$|<>"
PENALTY, RIDGE = 1.0, 1e-5
STEPS, RATE, MOMENTUM = 800, 0.3, 0.95
#: Counterfactuals of each training text that names a group.
SWAPS = 4
_IDENTITY = frozenset(IDENTITY_TERMS)


def word_features(word: str) -> list[str]:
    """A lower-case word and, unless it names a group, its beginnings as names of features."""
    if word in _IDENTITY:
        return [f"={word}"]
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) > n)]


def plain_words(text: str) -> set[str]:
    """Words of a text in lower case, without marks at their edges."""
    return {word.strip(EDGES) for word in set(WORD_PATTERN.findall(text.lower()))} - {""}


def held_out(key: str | Column) -> Column:
    """Whether a row's label may not be learned from; null keys count as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Classifier:
    """Weight per feature and the bias."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        # few words begin like any feature with a weight
        self.heads = {f[1:] if f[0] == "=" else f for f in self.weights}
        self.heads = {head[: PREFIXES[0]] for head in self.heads}

    def score(self, words: set[str]) -> float:
        """Probability that a text with these words is toxic."""
        weights, found = self.weights, set()
        for word in words:
            if word[: PREFIXES[0]] in self.heads:
                found.update(f for f in word_features(word) if f in weights)
        logit = self.bias + sum(sorted(weights[f] for f in found))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def clear_features(texts: Sequence[set[str]], labels: np.ndarray) -> list[str]:
    """Features whose share in one class of texts stands out against the other."""
    counts = (Counter(), Counter())
    for words, label in zip(texts, labels, strict=True):
        counts[int(label)].update({f for word in words for f in word_features(word)})
    toxic, clean = max(1, int(labels.sum())), max(1, int((labels == 0).sum()))
    clear = []
    for feature in counts[0].keys() | counts[1].keys():
        n, m = counts[1][feature], counts[0][feature]
        p = (n + m + 1) / (toxic + clean + 2)
        score = (n / toxic - m / clean) / np.sqrt(p * (1 - p) * (1 / toxic + 1 / clean))
        if abs(score) >= CLEAR and (n if score > 0 else m) >= LEAST:
            clear.append(feature)
    return sorted(clear)


def counterfactuals(texts: Sequence[set[str]], rng: np.random.Generator, swaps: int = SWAPS) -> list[tuple[int, set[str]]]:
    """Number and words of texts in which each name of a group became another one, distinct names distinct ones."""
    out = []
    for i, words in enumerate(texts):
        named = sorted(words & _IDENTITY)
        others = sorted(_IDENTITY - set(named))
        for _ in range(swaps if named else 0):
            # a text that names most groups has them change places
            drawn = rng.choice(others, len(named), replace=False) if len(named) <= len(others) else np.roll(named, 1)
            out.append((i, (words - _IDENTITY) | set(map(str, drawn))))
    return out


@dataclass
class Loss:
    """Log loss of texts, mean squared change of the score by counterfactuals, and ridge, over sets of features."""

    texts: Sequence[set[str]]
    labels: np.ndarray
    swapped: Sequence[tuple[int, set[str]]]
    features: Sequence[str]

    def __post_init__(self):
        number = {feature: i for i, feature in enumerate(self.features)}
        known: dict[str, list[int]] = defaultdict(list)

        def held(words: set[str]) -> set[int]:
            for w in words:
                if w not in known:
                    known[w] = [number[f] for f in word_features(w) if f in number]
            return {i for w in words for i in known[w]}

        own = [held(words) for words in self.texts]
        self.rows = _entries([dict.fromkeys(found, 1) for found in own])
        changes = []
        for i, words in self.swapped:
            after = held(words)
            changes.append(dict.fromkeys(own[i] - after, 1) | dict.fromkeys(after - own[i], -1))
        self.changes = _entries(changes)
        # both classes weigh the same, however many of each there are
        toxic, clean = max(1, int(self.labels.sum())), max(1, int((self.labels == 0).sum()))
        self.weigh = np.where(self.labels == 1, 0.5 / toxic, 0.5 / clean)

    def _logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return _totals(self.rows, weights, len(self.texts)) + bias

    def value(self, weights: np.ndarray, bias: float) -> float:
        signs = np.where(self.labels == 1, -1, 1)
        log_loss = (self.weigh * np.logaddexp(0, signs * self._logits(weights, bias))).sum()
        apart = _totals(self.changes, weights, len(self.swapped))
        return float(log_loss + PENALTY * (apart**2).sum() / max(1, len(apart)) + RIDGE / 2 * (weights**2).sum())

    def slopes(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        wrong = self.weigh * (1 / (1 + np.exp(-np.clip(self._logits(weights, bias), -30, 30))) - self.labels)
        apart = 2 * PENALTY / max(1, len(self.swapped)) * _totals(self.changes, weights, len(self.swapped))
        size = len(self.features)
        return _per_feature(self.rows, wrong, size) + _per_feature(self.changes, apart, size) + RIDGE * weights, float(wrong.sum())

    def curvature(self) -> np.ndarray:
        """How fast each slope changes, at most for the penalty and about for the log loss."""
        size, (row, at, sign) = len(self.features), self.changes
        width = np.bincount(self.rows[0], minlength=1).max()
        changed = np.bincount(row, minlength=len(self.swapped))
        penalty = 2 * PENALTY / max(1, len(self.swapped)) * np.bincount(at, weights=np.abs(sign) * changed[row], minlength=size)
        return _per_feature(self.rows, self.weigh, size) * np.sqrt(max(1, width)) / 4 + penalty + RIDGE


def _entries(rows: Sequence[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each entry."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = [pair for r in rows for pair in sorted(r.items())]
    return row, np.array([i for i, _ in pairs], int), np.array([v for _, v in pairs], float)


def _totals(entries, weights: np.ndarray, n: int) -> np.ndarray:
    row, at, value = entries
    return np.bincount(row, weights=weights[at] * value, minlength=n)


def _per_feature(entries, values: np.ndarray, size: int) -> np.ndarray:
    row, at, value = entries
    return np.bincount(at, weights=values[row] * value, minlength=size)


def train(texts: Sequence[set[str]], labels: np.ndarray, seed: int = 3) -> Classifier:
    """Fit weights by gradient steps on log loss, swap penalty and ridge, each step scaled by curvature."""
    features = sorted({f"={term}" for term in IDENTITY_TERMS} | set(clear_features(texts, labels)))
    loss = Loss(texts, labels, counterfactuals(texts, np.random.default_rng(seed)), features)
    weights, bias = np.zeros(len(features)), 0.0
    moving, shift = np.zeros(len(features)), 0.0
    step = RATE / loss.curvature()
    for _ in range(STEPS if len(texts) else 0):
        slopes, slope = loss.slopes(weights, bias)
        moving = MOMENTUM * moving - step * slopes
        shift = MOMENTUM * shift - RATE * slope
        weights += moving
        bias += shift
    return Classifier({f: float(w) for f, w in zip(features, weights, strict=True) if abs(w) > 1e-6}, float(bias))


def _word_sets(docs: DataFrame) -> DataFrame:
    """``_key, _label, _words`` of ``_key, _label, _text``."""
    schema = T.StructType([*docs.schema.fields[:2], T.StructField("_words", T.ArrayType(T.StringType()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                words = pa.array([sorted(plain_words(t)) for t in texts], pa.list_(pa.string()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], schema.names)

    return docs.mapInArrow(split, schema)


def fitted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS,
) -> Classifier:
    """Train on at most ``per_class`` labelled documents of each class, the first by a hash of their keys.

    Rows that are held out, and null keys and labels, are never learned from; of the documents of one key
    the least text is, and a label that repeats counts once. Without any label the classifier gives every
    text the same score.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")
    ).distinct()
    order = [F.xxhash64(F.lit(5), "_key"), F.col("_key")]
    sample = stage(
        usable.where("_label = 0").orderBy(*order).limit(per_class).unionByName(
            usable.where("_label = 1").orderBy(*order).limit(per_class)
        ),
        "toxicity_sample",
    )
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    # a key may repeat without bound: one text of each comes to the driver
    found = found.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    rows = []
    for row in _word_sets(found.select("_key", "_label", "_text")).toLocalIterator():
        rows.append((row["_key"], row["_label"], {sys.intern(word) for word in row["_words"]}))
    rows.sort(key=lambda r: (r[1], r[0], sorted(r[2])))
    return train([words for *_, words in rows], np.array([y for _, y, _ in rows], dtype=float))


def toxicity_scores(
    docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """All columns of ``docs``, and behind them the score and the prediction.

    Null and empty texts are scored as texts without words. Labels are not read.
    """
    weights, bias = classifier.weights, classifier.bias
    at = docs.columns.index(text)
    added = [
        T.StructField(fresh("score", docs.columns), T.DoubleType()),
        T.StructField(fresh("predicted", docs.columns), T.IntegerType()),
    ]
    schema = T.StructType([*docs.schema.fields, *added])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed_worker()
        model = Classifier(weights, bias)
        for batch in batches:
            scores = [model.score(plain_words(t)) for _, texts in text_slices(batch.column(at)) for t in texts]
            scores = np.array(scores, dtype=float)
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(predicted)], schema.names)

    return docs.mapInArrow(score, schema)


def scored_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``key, held_out, score, predicted`` for every document; one row per row, also of repeated keys.

    Null texts count as empty, an empty table gives no rows, other columns are not read.
    """
    classifier = fitted(docs, labels, key, text, **settings)
    given = docs.select(F.col(key), F.col(text).alias("_text"))
    scored = toxicity_scores(given, classifier, key, "_text")
    return scored.select(key, held_out(key).alias("held_out"), *(F.col(name) for name in scored.columns[2:]))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    classifier = fitted(docs, labels, key, text, **settings)
    scored = toxicity_scores(docs, classifier, key, text)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)
