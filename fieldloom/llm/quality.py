"""Quality rules: a hashed n-gram logistic regression, calibrated, beside fixed count rules.

``rate_quality`` gives every row of ``docs`` its counts, base verdict, calibrated probability and
verdict. Defined cases: a missing text has no words; repeated rows are rated one by one; extra
columns are ignored; a label table that is empty, has one class only or matches no text gives no model,
and then the base rules decide alone. Labels of one document that differ leave it out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytewords as B
from .tables import keyed_texts, lean, ship

WORD_BITS = 15
SLOTS = 3 << WORD_BITS
CHAR_GRAM = 4
GAIN = 40.0

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, p_good double")

SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -60, 60)))


def _features(data, offsets, words):
    """Slot and row of every feature: words, word pairs, and byte n-grams."""
    starts, ends, row = words
    shift = np.uint64(64 - WORD_BITS)
    hashes = B.span_hashes(data, starts, ends)
    yield (hashes >> shift).astype(np.int32), row
    first, pairs = B.grams(hashes, row, 2)
    yield (pairs >> shift).astype(np.int32) + (1 << WORD_BITS), row[first]
    m = len(data) - CHAR_GRAM + 1
    if m > 0:
        packed = np.zeros(m, np.uint32)
        for j in range(CHAR_GRAM):
            packed = (packed << np.uint32(8)) | data[j:j + m]
        slot = ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - WORD_BITS)).astype(np.int32)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = owner[:m] == owner[CHAR_GRAM - 1:]
        yield slot[inside] + (2 << WORD_BITS), owner[:m][inside]


def _scores(model: QualityModel, data, offsets, words) -> np.ndarray:
    rows = len(offsets) - 1
    total = np.full(rows, model.bias)
    for slot, row in _features(data, offsets, words):
        n = np.bincount(row, minlength=rows)
        total += GAIN * np.bincount(row, model.weights[slot], minlength=rows) / np.maximum(n, 1)
    return total


def _counts(data, offsets, words):
    starts, ends, row = words
    rows = len(offsets) - 1
    points = B.code_points(data)
    n_words = B.counts(row, rows)
    chars = B.counts(row, rows, points[ends] - points[starts])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    hashes = B.span_hashes(data, starts, ends)
    first, gram = B.grams(hashes, row, 3)
    covered = np.zeros(len(starts) + 1, np.int64)
    twice = first[B.repeated(gram, row[first])]
    np.add.at(covered, twice, 1)
    np.add.at(covered, np.minimum(twice + 3, len(starts)), -1)
    n_repeat = B.counts(row, rows, np.cumsum(covered[:-1]) > 0)
    line_start, line_end, line_row = B.lines(data, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    n_dup = B.later_copies(B.span_hashes(data, line_start, line_end), line_row, rows)
    return n_words, chars, n_symbols, n_dup, n_repeat


def _rate(model: QualityModel | None, texts: pa.Array, threshold: float, min_words: int, repeat_percent: int) -> list[pa.Array]:
    """The columns of SCHEMA after the id."""
    data, offsets = B.text_bytes(texts)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)] + [[np.zeros(0)]]
    for _, _, part, cuts in B.runs(data, offsets):
        words = B.pieces(part, cuts, B.SPACE)
        for k, v in enumerate(_counts(part, cuts, words)):
            out[k].append(v)
        out[5].append(np.full(len(cuts) - 1, np.nan) if model is None else model.probability(_scores(model, part, cuts, words)))
    n_words, chars, n_symbols, n_dup, n_repeat, p = map(np.concatenate, out)
    failed = (n_words < min_words) | (100 * n_repeat > repeat_percent * n_words)
    kept = ~failed & (np.isnan(p) | (p >= threshold))
    return [*map(pa.array, (n_words, chars, n_symbols, n_dup, n_repeat, failed, kept)), pa.array(p, mask=np.isnan(p))]


def keep_good(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, min_words: int = 50,
              repeat_percent: int = 50) -> DataFrame:
    """The rows of ``docs``, all columns, that ``rate_quality`` keeps; nothing is shuffled."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_rate(shared.value, batch.column(at).cast(pa.string()), threshold, min_words, repeat_percent)[6])

    return docs.mapInArrow(lean(keep), docs.schema)


def rate_quality(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, min_words: int = 50,
                 repeat_percent: int = 50) -> DataFrame:
    """Counts and verdict of every document; ``kept`` needs the base rules and p_good >= threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS doubles, whatever the input

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = _rate(shared.value, batch.column(1), threshold, min_words, repeat_percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=SCHEMA_NAMES)

    return keyed_texts(docs).mapInArrow(lean(rate), SCHEMA)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class, picked by a hash of the id: text, good."""
    one = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
           .agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high"))
    order = F.xxhash64("doc_id")
    picked = [one.where(F.col("low") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1]).select("doc_id", F.col("low").alias("good"))
    # At most 2 * per_class rows: of rows that repeat an id, the least text counts.
    return keyed_texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 600, passes: int = 150, ridge: float = 1e-4) -> QualityModel | None:
    """Fit on a bounded sample: ``per_class`` rows of each class, a third of them held out for calibration.

    The sparse features are made in tasks; the driver gets at most 2 * per_class rows of them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_bytes(batch.column("text"))
            slots, values = [], []
            for first, end, part, cuts in B.runs(data, offsets):
                words = B.pieces(part, cuts, B.SPACE)
                found = list(_features(part, cuts, words))
                for i in range(end - first):
                    s, v = [], []
                    for slot, row in found:
                        own = slot[np.searchsorted(row, i):np.searchsorted(row, i, side="right")]
                        u, n = np.unique(own, return_counts=True)
                        s.append(u)
                        v.append(GAIN * n / max(len(own), 1))
                    slots.append(np.concatenate(s))
                    values.append(np.concatenate(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("good"), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                names=["doc_id", "good", "slots", "vals"])

    rows = (labelled_sample(docs, labels, per_class).select("doc_id", F.col("good").cast("int").alias("good"), "text")
            .mapInArrow(lean(encode), "doc_id bigint, good int, slots array<int>, vals array<double>").toPandas())
    rows = rows.sort_values("doc_id", kind="stable")
    if rows["good"].nunique() < 2 or rows["good"].value_counts().min() < 6:
        return None
    held = np.zeros(len(rows), bool)
    for c in (0, 1):
        held[np.flatnonzero(rows["good"] == c)[::3]] = True
    y = rows["good"].to_numpy(float)
    size = rows["slots"].map(len).to_numpy()
    slot, value = np.concatenate(rows["slots"].to_numpy()), np.concatenate(rows["vals"].to_numpy())
    owner = np.repeat(np.arange(len(rows)), size)
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    weights, bias = np.zeros(SLOTS), 0.0
    speed, speed_bias, rate = np.zeros(SLOTS), 0.0, 0.0
    use = np.where(held, 0.0, balance)
    norm = float(np.bincount(owner, value**2).max()) / 4 + 1
    for step in range(passes):  # accelerated gradient descent with step 1 / curvature bound
        nxt = (1 + np.sqrt(1 + 4 * rate * rate)) / 2
        pull = (rate - 1) / nxt if step else 0.0
        w, b = weights + pull * (weights - speed), bias + pull * (bias - speed_bias)
        z = np.bincount(owner, value * w[slot], minlength=len(y)) + b
        miss = use * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / use.sum()
        grad = np.bincount(slot, value * miss[owner], minlength=SLOTS) + ridge * w
        speed, speed_bias, rate = weights, bias, nxt
        weights, bias = w - grad / norm * 8, b - miss.sum() / norm * 8
    score = np.bincount(owner, value * weights[slot], minlength=len(y)) + bias
    slope, offset = platt(score[held], y[held], balance[held])
    return QualityModel(weights, float(bias), slope, offset)


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out scores, by Newton steps with smoothed targets."""
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -60, 60)))
        g = np.array([(weight * (p - target) * score).sum(), (weight * (p - target)).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * score * score).sum() + 1e-6, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
    return float(max(a, 1e-3)), float(b)
