"""Text quality by a generalised additive model with pairwise interactions.

Features of a text (sizes, shares of kinds of characters and words, repetition) are binned; cyclic boosting
visits one feature after the other and adds a shallow tree over its bins, shrunk, to the feature's lookup
table; then the pairs that explain most of the rest get tables of their own. A score is the logistic of a
sum of table entries, so scoring adds up one entry for each feature and pair.

The model is fitted on at most ``SAMPLE`` labelled documents, those whose hashed ids come first among
the labelled ones of the training folds; every document is scored on its whole text. Language, source, id
and label are no inputs of a score.

Defined results: null and empty texts are scored as texts of no words; without any label on one of both
sides every score is the share of good labels (0.5 without labels); repeated rows get equal scores; labels
that are null do not count; of several labels of one document the best counts, and of several texts of one id the
model learns from the first in order of bytes; an empty table gives an empty result. Of the tables only id, text and label are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm.text import slices, utf8, windows, with_distinct, words
from glyphweave.workdir import Work

SAMPLE = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, LEAF = 32, 150, 0.1, 8, 60, 20

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "stop": b".,;:?", "bang": b"!", "mark": b"#%$*&^~=+<>\\_`@", "bar": b"|/",
    "bracket": b"()[]{}", "quote": b"\"'", "line": b"\n",
}
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _i
FEATURES = [f"share_{k}" for k in _KINDS] + [
    "log_words", "log_bytes", "word_mean", "word_spread", "short_words", "long_words", "upper_words", "odd_words", "distinct_words", "top_word", "distinct_pairs", "log_lines", "line_words", "repeated_lines", "repeated_line_bytes",
]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    body, offsets = utf8(column)
    m, size = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    starts, ends, hashes, rows = words(body, offsets)
    row, length, n = np.repeat(np.arange(m), np.diff(rows)), (ends - starts).astype(np.float64), np.diff(rows).astype(np.float64)
    doc = np.repeat(np.arange(m), np.diff(offsets))
    kind = _KIND[body]
    shares = np.bincount(doc * (len(_KINDS) + 1) + kind, minlength=m * (len(_KINDS) + 1)).reshape(m, -1)[:, :-1] / np.maximum(size, 1)[:, None]
    per = lambda w=None: np.bincount(row, w, minlength=m)
    mean = _over(per(length), n)
    spread = np.sqrt(np.maximum(_over(per(length * length), n) - mean**2, 0))
    counted = lambda kinds: np.diff(np.concatenate([[0], np.cumsum(np.isin(kind, kinds))])[np.stack([starts, ends], 1)], axis=1)[:, 0] if len(starts) else np.zeros(0)
    upper, letters = counted([0]), counted([0, 1, 3])
    keys, _, counts = with_distinct(row, hashes)
    distinct = np.bincount(keys, minlength=m)
    top = np.zeros(m)
    np.maximum.at(top, keys, counts)
    pairs = windows(hashes, 2)
    inside = row[: len(pairs)] == row[1:] if len(pairs) else np.zeros(0, bool)
    pair_rows = row[: len(pairs)][inside]
    distinct_pairs = np.bincount(with_distinct(pair_rows, pairs[inside])[0], minlength=m)
    # lines: runs of words between line breaks, by the sum of their words' hashes in order
    breaks = np.concatenate([[0], np.cumsum(body == 10)])
    first = np.ones(len(starts), bool)
    if len(starts):
        first[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(starts))
    place = (np.arange(len(starts)) - np.repeat(begin, end - begin)).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    line = np.add.reduceat(hashes * (place * np.uint64(2) + np.uint64(1)), begin) if len(begin) else np.zeros(0, np.uint64)
    line_row, line_bytes = row[begin], (ends[end - 1] - starts[begin]).astype(np.float64) if len(begin) else np.zeros(0)
    lines = np.bincount(line_row, minlength=m).astype(np.float64)
    own, value, times = with_distinct(line_row, line)
    order = np.lexsort((line, line_row))
    bytes_of = np.add.reduceat(line_bytes[order], np.cumsum(times) - times) if len(times) else np.zeros(0)
    repeated = np.bincount(own, times - 1.0, minlength=m)
    repeated_bytes = np.bincount(own, _over(bytes_of, times) * (times - 1), minlength=m)
    rest = [
        np.log1p(n), np.log1p(size), mean, spread, _over(per((length <= 2) * 1.0), n), _over(per((length >= 16) * 1.0), n), _over(per((upper >= 2) * 1.0), n), _over(per((letters * 2 < length) * 1.0), n),
        _over(distinct, n), _over(top, n), _over(distinct_pairs, np.bincount(pair_rows, minlength=m)), np.log1p(lines), _over(n, lines), _over(repeated, lines), _over(repeated_bytes, size),
    ]
    return np.column_stack([shares, *rest])


def _tree(gain: np.ndarray, weight: np.ndarray, leaf: float, depth: int = 2) -> np.ndarray:
    """Newton steps of a shallow tree over bins in order: the same step for all bins of a leaf."""
    out = np.full(len(gain), gain.sum() / (weight.sum() + 1.0))
    if depth and len(gain) > 1:
        g, w = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
        rest_g, rest_w = gain.sum() - g, weight.sum() - w
        value = np.where((w * 4 >= leaf) & (rest_w * 4 >= leaf), g * g / (w + 1) + rest_g * rest_g / (rest_w + 1), -1)
        k = int(value.argmax())
        if value[k] > gain.sum() ** 2 / (weight.sum() + 1) + 1e-9:
            out[: k + 1], out[k + 1 :] = _tree(gain[: k + 1], weight[: k + 1], leaf, depth - 1), _tree(gain[k + 1 :], weight[k + 1 :], leaf, depth - 1)
    return out


def _corners(gain: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a pair's table in four parts: the step of each cell, and what it gains."""
    g, w = gain.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    parts = []
    for x in (g, w):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        parts.append((a, b, c, x[-1, -1] - a - b - c))
    value = sum(p * p / (q + 1) for p, q in zip(*parts, strict=True))
    i, j = np.unravel_index(value.argmax(), value.shape)
    step = np.empty_like(gain)
    for (p, q), at in zip(zip(*parts, strict=True), ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        step[at] = p[i, j] / (q[i, j] + 1)
    return step, float(value[i, j] - gain.sum() ** 2 / (weight.sum() + 1))


class Gam:
    """Lookup tables of single features and of pairs."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit on feature rows and labels 0 or 1."""
    share = (y.sum() + 0.5 if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5) / (len(y) + 1 if 0 < y.sum() < len(y) else 1)
    share = min(max(share, 1e-9), 1 - 1e-9)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Gam([], base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Gam(cuts, base)
    b, score = model.bins(x), np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-score))
            step = RATE * _tree(np.bincount(b[:, j], y - p, len(table)), np.bincount(b[:, j], p * (1 - p), len(table)), LEAF)
            table += step
            score += step[b[:, j]]
    p = 1 / (1 + np.exp(-score))

    def sums(i: int, j: int, w: np.ndarray) -> np.ndarray:
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], w, shape[0] * shape[1]).reshape(shape)

    usable = [(i, j) for i, j in combinations(range(x.shape[1]), 2) if len(cuts[i]) and len(cuts[j])]
    gains = {(i, j): _corners(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1] for i, j in usable}
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in sorted(gains, key=gains.get, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-score))
            step = RATE * _corners(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0]
            table += step
            score += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fit on labelled documents outside the held-out fold, at most ``sample`` of them."""
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    told = told.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(told), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            found = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, x array<double>").toArrow().sort_by("doc_id")
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, (got["label"].to_numpy() > 0).astype(np.float64))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gam = model.value
        for batch in (x for b in batches for x in slices(b)):
            score = gam.predict(features(batch.column(1)))
            held = [i is not None and held_out(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return Work(spark, "quality").write(rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"), "result")
