"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score of a text is the logistic function of a bias, a weight per feature and the products
of all feature pairs, weighted by the scalar products of their factor rows. The pairs are
never listed: for each factor they are half of (sum of v x)^2 - sum of (v x)^2, so scoring is
linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from salesmart.llm.common import key_remainder, map_rows, ship_package
from salesmart.sources.staging import stage

#: Buckets of hashed words; a power of two. Statistics stand behind them.
BUCKETS = 1 << 16
#: Factors per feature.
FACTORS = 4
#: Bounds of the training sample: labelled rows, those of the smallest key hashes, and their
#: features together, 8 bytes each. A text has at most BUCKETS + STATISTICS.
SAMPLE_ROWS, SAMPLE_FEATURES = 8000, 8_000_000
#: Length of a text's word features together, against statistics of up to 1.
WORD_LENGTH = 0.3
EPOCHS = 6
RATE = 0.1
DECAY = 1e-5
#: Documents of this score or more count as good.
THRESHOLD = 0.7
#: Rows whose key remainder by FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2

_BYTES = np.arange(256)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWER = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
_DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_SYMBOL = (_BYTES > ord(" ")) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
LENGTH_STEPS = 8
STATISTICS = 11 + LENGTH_STEPS


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def statistics(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """Shares that tell prose from lists, tables, shouting, noise and repetition."""
    out = np.zeros(STATISTICS, np.float32)
    if not words:
        out[10] = 1
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    histogram = np.bincount(data, minlength=256)
    upper, lower, digits, symbols = (
        int(histogram[kind].sum()) for kind in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
    symbol = _SYMBOL[data]
    number = len(words)
    out[0] = upper / max(1, upper + lower)
    out[1] = digits / len(data)
    out[2] = min(1.0, symbols / number / 2)
    out[3] = min(1.0, int((symbol[1:] & symbol[:-1]).sum()) / number)
    out[4] = sum(map(eq, words, words[1:])) / number
    out[5] = len(counts) / number
    out[6] = max(counts.values()) / number
    out[7] = min(1.0, len(text) / number / 20)
    out[8] = sum(counts[w] for w in counts if not any(map(str.isalnum, w))) / number
    out[9] = min(1.0, int(histogram[10]) * 10 / number)
    out[11 + min(LENGTH_STEPS - 1, number.bit_length() // 2)] = 1
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: word buckets of WORD_LENGTH together, then statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    buckets: dict[int, float] = {}
    for word, count in counts.items():
        bucket = zlib.crc32(word.lower().encode()) & (BUCKETS - 1)
        buckets[bucket] = buckets.get(bucket, 0) + count
    values = np.log1p(np.fromiter(buckets.values(), np.float32, len(buckets)))
    values *= WORD_LENGTH / max(1e-9, float(np.sqrt(values @ values)))
    shape = statistics(text, words, counts)
    used = np.flatnonzero(shape)
    numbers = np.fromiter(buckets.keys(), np.int32, len(buckets))
    return (np.concatenate([numbers, BUCKETS + used]).astype(np.int32),
            np.concatenate([values, shape[used]]).astype(np.float32))


def raw_score(model: Model, numbers: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
    """The score before the logistic function, and the weighted factor sums."""
    scaled = model.factors[numbers] * values[:, None]
    sums = scaled.sum(axis=0)
    pairs = 0.5 * float((sums * sums - (scaled * scaled).sum(axis=0)).sum())
    return model.bias + float(model.weights[numbers] @ values) + pairs, sums


def raw_scores(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The scores of many rows: one sparse matrix, summed row by row. No row is without features."""
    if not rows:
        return np.empty(0)
    starts = np.cumsum([0, *(len(numbers) for numbers, _ in rows[:-1])])
    numbers, values = (np.concatenate(side) for side in zip(*rows, strict=True))
    scaled = model.factors[numbers] * values[:, None]
    sums = np.add.reduceat(scaled, starts)
    pairs = 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, starts)).sum(axis=1, dtype=np.float64)
    return model.bias + np.add.reduceat(model.weights[numbers] * values, starts).astype(np.float64) + pairs


def logistic(value: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Adaptive gradient steps over the rows, classes weighted to count the same.

    Without rows of both classes the model knows only the share of good rows.
    """
    good = sum(label for *_, label in rows)
    bias = float(np.log((good + 1) / (len(rows) - good + 1)))
    random = np.random.default_rng(7)
    size = BUCKETS + STATISTICS
    weights = np.zeros(size, np.float32)
    factors = random.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    if not 0 < good < len(rows):
        return Model(bias, weights, factors * 0)
    share = {1: len(rows) / (2 * good), 0: len(rows) / (2 * (len(rows) - good))}
    bias, bias_square = 0.0, 1e-6
    weight_squares = np.full(size, 1e-6, np.float32)
    factor_squares = np.full((size, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        for at in random.permutation(len(rows)).tolist():
            numbers, values, label = rows[at]
            score, sums = raw_score(Model(bias, weights, factors), numbers, values)
            slope = np.float32((logistic(score) - label) * share[label])
            step = slope * values + DECAY * weights[numbers]
            weight_squares[numbers] += step * step
            weights[numbers] -= RATE * step / np.sqrt(weight_squares[numbers])
            own = factors[numbers]
            step = slope * (values[:, None] * sums - own * (values * values)[:, None]) + DECAY * own
            factor_squares[numbers] += step * step
            factors[numbers] -= RATE * step / np.sqrt(factor_squares[numbers])
            bias_square += float(slope) ** 2
            bias -= RATE * float(slope) / bias_square ** 0.5
    return Model(bias, weights, factors)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          sample_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Features are made on the executors; at most ``sample_rows`` rows and ``sample_features``
    features come back, in one order whatever the layout of the tables. Labels without a doc_id or
    quality are left out; of a doc_id labelled twice the lower counts. Rows equal in doc_id and
    text count once.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("bigint").alias("label_id")).agg(F.min("quality").alias("quality"))
    chosen = known.where(key_remainder("label_id", FOLDS) != HELD_OUT).orderBy(
        F.xxhash64("label_id"), "label_id").limit(sample_rows)
    # At most sample_rows pairs of numbers: a proven bound.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text", F.col("quality").cast("int"))

    def make():
        def work(source):
            for doc_id, text_hash, text, label in source:
                numbers, values = features(text)
                yield doc_id, text_hash, numbers.tobytes(), values.tobytes(), label, len(numbers)
        return work

    made = stage(map_rows(
        rows.dropDuplicates(["doc_id", "text_hash"]), "doc_id bigint, text_hash bigint, numbers binary, "
        "amounts binary, label int, size int", make), "labelled")
    # The window sees two times sample_rows small rows at most, and the features stay where they are.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    first = made.select("doc_id", "text_hash", "size").orderBy(*order).limit(2 * sample_rows)
    within = first.withColumn("total", F.sum("size").over(Window.orderBy(*order))).where(
        F.col("total") <= sample_features).select("doc_id", "text_hash")
    found = made.join(within, ["doc_id", "text_hash"], "left_semi").orderBy(
        "doc_id", "text_hash").select("numbers", "amounts", "label").collect()
    return fit([(np.frombuffer(row["numbers"], np.int32), np.frombuffer(row["amounts"], np.float32),
                 row["label"]) for row in found])


def scorer(model: Model):
    """A column function that scores texts, Arrow batch by Arrow batch."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(map(logistic, raw_scores(model, list(map(features, texts))))),
                            dtype="float64")
    return score


def quality(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of a text column: 0 to 1, for null and empty texts too."""
    ship_package(docs.sparkSession)
    return scorer(model)(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only the text is scored. A null text scores as an empty one; a null doc_id is not held
    out; repeated rows are scored each; an empty ``labels`` gives one score for all.
    """
    model = train(docs, labels)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (key_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        quality(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier calls good, all columns as they are.

    Without labels of both classes there is nothing to judge by, and all stay.
    """
    model = train(docs, labels)
    if not model.weights.any():
        return docs
    return docs.where(quality(docs, model) >= THRESHOLD)
