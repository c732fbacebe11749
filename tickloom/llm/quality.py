"""Quality rules: countable base rules, and a classifier trained on labelled rows.

The classifier is a logistic regression on hashed words and hashed byte trigrams of the
whole text (relative frequencies, so length doesn't matter). It is fitted on a bounded
sample of labelled rows, calibrated on a part of it that the fit has not seen (Platt's
scaling), and scored in Arrow batches against a fixed threshold.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (BYTE_VALUES, LOWER, SPACED, U64, _classes, dense, flat, gram_hashes, mix, prefix_hashes,
                     slices, stretch_hashes, words)
from .passages import covered

#: Slots for words and as many for trigrams; labelled rows that the fit may read at most.
SLOTS, SAMPLE_ROWS = 1 << 12, 2000
#: A text is kept from this probability of good quality on.
THRESHOLD = 0.3
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Texts scored at a time, so that memory doesn't follow the number of short texts.
ROWS = 512

SYMBOLS = _classes(lambda b: chr(b) in "#*$%&|<>")
BASE = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean")
SCHEMA = BASE + ", score double, kept boolean"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def _marks(data: np.ndarray) -> np.ndarray:
    """First bytes of code points."""
    return (data & 0xC0) != 0x80


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more."""
    order, first = dense(keys)
    size = np.diff(np.r_[first, len(order)])
    out = np.empty(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = words(data, offsets, SPACED)
    doc, n_words = w.doc, np.diff(w.offsets)
    hashes = w.hashes()
    chars = np.r_[0, np.cumsum(_marks(w.data))]
    word_chars = np.diff(np.r_[0, np.cumsum(chars[w.end] - chars[w.start])][w.offsets])
    # lines, by text and content; every text starts one
    cut = w.data == 0x0A
    line_end = np.flatnonzero(np.r_[cut, True])
    line_start = np.r_[0, line_end[:-1] + 1]
    line_doc = np.searchsorted(w.text_start, line_start, "right") - 1
    has_word = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end, line_doc = (x[has_word] for x in (line_start, line_end, line_doc))
    line = stretch_hashes(prefix_hashes(BYTE_VALUES[w.data]), line_start, line_end)
    order, first = dense(mix(line + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15)))
    lines = np.bincount(line_doc, minlength=len(n_words))
    kinds = np.bincount(line_doc[order[first]], minlength=len(n_words))
    grams = gram_hashes(prefix_hashes(hashes), REPEAT_WINDOW)
    own = doc[:len(grams)]
    inside = own == doc[REPEAT_WINDOW - 1:] if len(grams) else np.zeros(0, bool)
    flags = np.zeros(len(doc), bool)
    flags[np.flatnonzero(inside)] = repeated(mix(grams[inside] + own[inside].astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
    repeat = _per_text(covered(flags, REPEAT_WINDOW), w.offsets)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(SYMBOLS[data], offsets),
            "n_dup_lines": lines - kinds, "n_repeat_words": repeat,
            "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEATED_PERCENT * n_words)}


def slots(data: np.ndarray, offsets: np.ndarray, n: int):
    """Slot and text of each word and of each trigram."""
    w = words(data, offsets, SPACED)
    word = (w.hashes() & U64(n - 1)).astype(np.int64)
    low = LOWER[w.data]
    gram = gram_hashes(prefix_hashes(BYTE_VALUES[low]), 3)
    # trigrams within a text, the byte after it included
    owner = np.searchsorted(w.text_start, np.arange(len(gram)), "right") - 1
    good = np.arange(len(gram)) + 3 <= w.text_start[owner + 1] if len(gram) else np.zeros(0, bool)
    return (word, w.doc), ((gram[good] & U64(n - 1)).astype(np.int64) + n, owner[good])


def features(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Relative frequency of each slot, a row for each text."""
    out = []
    for slot, doc in slots(data, offsets, n):
        size = np.bincount(doc, minlength=len(offsets) - 1)
        x = np.zeros((len(offsets) - 1) * 2 * n, np.float32)
        keys, counts = np.unique(doc * 2 * n + slot, return_counts=True)
        x[keys] = counts
        out.append(x.reshape(-1, 2 * n) / np.maximum(size, 1)[:, None])
    return out[0] + out[1]


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """features @ weights + bias, without the features."""
    total = np.full(len(offsets) - 1, bias)
    for slot, doc in slots(data, offsets, len(weights) // 2):
        size = np.bincount(doc, minlength=len(total))
        total += np.bincount(doc, weights[slot], minlength=len(total)) / np.maximum(size, 1)
    return total


def _pieces(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = flat(column)
    for a, b in slices(offsets):
        for first in range(a, b, ROWS):
            at = offsets[first:min(first + ROWS, b) + 1]
            yield data[at[0]:at[-1]], at - at[0]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent from zero; both classes weigh the same."""
    scale = x.std(axis=0) + 1e-3
    mean = x.mean(axis=0)
    x = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = ahead = np.zeros(x.shape[1] + 1)
    norm = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        norm = x.T @ (x @ norm)
        top = float(np.linalg.norm(norm)) or 1.0
        norm /= top
    rate = 1 / (0.25 * weight.max() * (top / len(y) + 1) + ridge)
    for t in range(steps):
        slip = weight * (_logistic(x @ ahead[:-1] + ahead[-1]) - y)
        step = np.r_[x.T @ slip / len(y) + ridge * ahead[:-1], slip.mean()]
        after = ahead - rate * step
        ahead = after + t / (t + 3) * (after - w)
        w = after
    plain = w[:-1] / scale
    return plain, float(w[-1] - mean @ plain)


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores probabilities of y = 1."""
    slope, offset = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = _logistic(slope * score + offset)
        gap, curve = p - target, p * (1 - p) + 1e-6
        grad = np.array([(gap * score).sum() + 1e-3 * (slope - 1), gap.sum()])
        hess = np.array([[(curve * score * score).sum() + 1e-3, (curve * score).sum()],
                         [(curve * score).sum(), curve.sum() + 1e-6]])
        change = np.linalg.solve(hess, grad)
        slope, offset = slope - float(np.clip(change[0], -2, 2)), offset - float(np.clip(change[1], -2, 2))
        if abs(change).max() < 1e-8:
            break
    return slope, offset


def _featurize(n: int):
    def run(batches):
        for batch in batches:
            rows = [r.astype(np.float32).tobytes() for d, o in _pieces(batch.column("text")) for r in features(d, o, n)]
            yield pa.record_batch({"id": batch.column("id"), "good": batch.column("good"), "x": pa.array(rows, pa.binary())})
    return run


def _fit(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    x = np.stack([np.frombuffer(r, np.float32) for r in table.column("x").to_pylist()])[order]
    y = table.column("good").to_numpy().astype(float)[order]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2:
        return pa.table({"weights": [np.zeros(x.shape[1]).tobytes()], "bias": [30.0], "slope": [1.0], "offset": [0.0]})
    weights, bias = fit_logistic(x[~held], y[~held])
    slope, offset = calibrate(x[held] @ weights + bias, y[held]) if len(set(y[held])) == 2 else (1.0, 0.0)
    return pa.table({"weights": [weights.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, slot_count: int = SLOTS):
    """(weights, bias, slope, offset) from at most ``sample_rows`` labelled rows, those with
    the smallest hash of their id, whatever the size of the tables. Rows with a quality
    other than 0 or 1 are left out; of several labels of a document the lowest counts.
    Without rows of both classes every text gets a probability near 1."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("good"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "good", "text")
            .mapInArrow(_featurize(slot_count), "id long, good int, x binary"))
    model = rows.groupBy().applyInArrow(_fit, "weights binary, bias double, slope double, offset double").first()
    if model is None:
        return np.zeros(2 * slot_count), 30.0, 1.0, 0.0
    return np.frombuffer(model["weights"], np.float64), model["bias"], model["slope"], model["offset"]


def judge(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of documents: doc_id, the base counts, base_failed, score (probability of
    good quality) and kept. Null and empty texts have no words, so they fail. Ids may be
    null or repeated; further columns are not read."""
    weights, bias, slope, offset = model

    def run(batches):
        for batch in batches:
            parts = []
            for data, at in _pieces(batch.column("text")):
                out = base_counts(data, at)
                out["score"] = _logistic(slope * scores(data, at, weights, bias) + offset)
                out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
                parts.append(out)
            if parts:
                yield pa.record_batch({"doc_id": batch.column("id")} | {
                    k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, without moving them."""
    weights, bias, slope, offset = model
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            kept = [np.zeros(0, bool)]
            for data, at in _pieces(batch.column(place)):
                score = _logistic(slope * scores(data, at, weights, bias) + offset)
                kept.append(~base_counts(data, at)["base_failed"] & (score >= threshold))
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
