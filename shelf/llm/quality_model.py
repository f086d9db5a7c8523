"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes one row of statistics. Trees are grown on a sample of labelled rows whose size is a
parameter, and laid out as arrays of complete trees, so that a batch of documents walks all of them with numpy
indexing only.

Defined results: a NULL text counts as the empty text; an empty text gets a score like any other. Repeated rows
get equal scores. Without labelled rows every score is 0.5, with labels of one class it is near that class's share.
A document without ``doc_id`` is scored, never learned from, and not held out. Columns that are not named are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "lower", "digit", "space", "stops", "excited",
    "symbols", "other_marks", "beyond_ascii", "lines_per_word", "distinct_words", "commonest_word", "doubled_words",
    "repeated_lines", "packed_size", "word_pairs", "marked_words", "shouted_words",
)

#: fixed values: byte classes
_STOPS, _EXCITED, _SYMBOLS = b".,;:?", b"!", b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Byte value to class number: upper, lower, digit, space, stops, excited, symbols, other, beyond ASCII."""
    classes = np.full(256, 7)
    classes[65:91], classes[97:123], classes[48:58] = 0, 1, 2
    classes[[9, 10, 11, 12, 13, 32]] = 3
    classes[list(_STOPS)], classes[list(_EXCITED)], classes[list(_SYMBOLS)] = 4, 5, 6
    classes[128:] = 8
    return classes


def document_statistics(texts: pd.Series) -> np.ndarray:
    """One row of ``FEATURES`` per whole text."""
    classes = _class_table()
    marks = {chr(c) for c in _EXCITED + _SYMBOLS}
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            continue
        size = len(raw)
        shares = np.bincount(classes, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 9) / size
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        n = max(len(words), 1)
        seen = Counter(words)
        row[0], row[1] = np.log1p(size), np.log1p(len(words))
        row[2] = sum(map(len, words)) / n
        row[3] = max(map(len, seen), default=0)
        row[4:13] = shares
        row[13] = len(lines) / n
        row[14] = len(seen) / n
        row[15] = max(seen.values(), default=0) / n
        row[16] = sum(map(str.__eq__, words, words[1:])) / n
        row[17] = 1 - len(set(lines)) / max(len(lines), 1)
        row[18] = len(zlib.compress(raw, 1)) / size
        row[19] = len(set(zip(words, words[1:], strict=False))) / n
        row[20] = sum(k for w, k in seen.items() if w[-1] in marks) / n
        row[21] = sum(k for w, k in seen.items() if w.isupper() and len(w) > 1) / n
    return out


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth as arrays; node k has the children 2k+1 and 2k+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        first_leaf = 2**self.depth - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - first_leaf]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each column's histogram, from its quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def grow_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0,
    least: float = 2.0,
) -> Forest:
    """Boost trees for the log loss; each split is found on histograms of gradient and curvature."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if not len(x):
        return Forest(0.0, depth, feature[:0], threshold[:0], value[:0])
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    cell = binned + np.arange(width) * bins
    margin = np.full(len(x), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (count, width, bins)
            g = np.bincount(at, np.repeat(slope, width), count * width * bins).reshape(shape)
            h = np.bincount(at, np.repeat(bend, width), count * width * bins).reshape(shape)
            gl, hl = g.cumsum(2)[..., :-1], h.cumsum(2)[..., :-1]
            gr, hr = g.sum(2, keepdims=True) - gl, h.sum(2, keepdims=True) - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
            gain -= (gl + gr) ** 2 / (hl + hr + ridge)
            gain[(hl < least) | (hr < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(count, -1).max(1) > 1e-6):
                f, b = divmod(int(best[k]), bins - 1)
                if b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + ridge)
        margin += value[t, leaf]
    return Forest(base, depth, feature, threshold, value)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal ``doc_id``, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame, label: str, max_rows: int) -> pd.DataFrame:
    """(label, statistics) of at most ``max_rows`` labelled documents outside fold 0.

    The sample takes the smallest hashes of ``doc_id``: it does not depend on partitions or order. A document
    labelled several times counts once, with its mean label.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(max_rows)
    )

    def statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"y": frame["y"], "x": list(document_statistics(frame["text"]))})

    # the sample has max_rows rows of 16 bytes at most
    picked = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    return picked.select("y", "text").mapInPandas(statistics, "y double, x array<double>").toPandas()


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 40_000, **shape) -> Forest:
    """A forest for ``label``, grown on a sample of at most ``max_rows`` labelled documents."""
    rows = training_rows(documents, labels, label, max_rows)
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # rows arrive in any order; sums of floats depend on it
    return grow_forest(x[order], rows["y"].to_numpy(float)[order], **shape)


def scorer(forest: Forest):
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(forest.score(document_statistics(text)))

    return score


def score_documents(documents: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 40_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; ``predicted`` is 1 from a score of ``cut`` on."""
    score = scorer(train(documents, labels, max_rows=max_rows))
    scored = documents.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 40_000) -> DataFrame:
    """The documents, with all their columns, whose score reaches ``cut``."""
    score = scorer(train(documents, labels, max_rows=max_rows))
    return documents.where(score(F.col("text")) >= cut)
