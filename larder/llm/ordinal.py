"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import bounded_sample
from larder.llm.textblocks import U64, Words, mix, prefix_sums, hash_spans, text_blocks

#: Rated rows learned from at most; the first in the order of a hash of their ids.
TRAIN_ROWS = 6_000
#: Hashed features: words, and the characters at word ends, each a share of the text's words.
BUCKETS = 1 << 14
#: Passes over the sample, rows of a step, step size, weight decay.
PASSES, STEP_ROWS, RATE, DECAY = 12, 64, 0.5, 1e-5
SEED = 23
#: Value of the features that say how much of a text repeats.
MARK = 0.5
#: A text is kept if the chance of at least this grade is a half or more.
KEEP_GRADE = 1


@dataclass
class Model:
    """P(grade >= j) = sigmoid(weights . x - threshold[j]) for j = 1.., thresholds in rising order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(rows x thresholds) probabilities of at least each grade."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bounds, buckets, values) per block of texts: the features of text i stand at bounds[i]:bounds[i + 1].

    Features are words (A-Z folded), their first and last bytes, and how they are written; a text's values of these have
    length one, so its size does not matter. Three more say how often the text repeats its words and its five-word
    shingles, counted on whole hashes, by its size, with a fixed value each. An empty text has none.
    """
    for first, end, data, starts in text_blocks(texts):
        words = Words(data, starts)
        sums = prefix_sums(data)
        begins, ends = words.begins, words.ends
        kinds = [
            words.hashes(lower=True), hash_spans(sums, begins, np.minimum(begins + 2, ends)) ^ U64(1),
            hash_spans(sums, np.maximum(ends - 2, begins), ends) ^ U64(2), _shape(data, words) ^ U64(3),
        ]
        keys = np.concatenate([mix(k) % U64(BUCKETS) for k in kinds]).astype(np.int64)
        owner = np.tile(words.document, len(kinds))
        cell, count = np.unique(owner * BUCKETS + keys, return_counts=True)
        value = np.sqrt(count.astype(np.float64))
        owner, keys = cell // BUCKETS, cell % BUCKETS
        norm = np.sqrt(np.bincount(owner, value * value, end - first))
        value /= norm[owner]
        grams, bounds = words.shingles()
        own, gram_own = _distinct(kinds[0], words.bounds), _distinct(grams, bounds)
        total, gram_total = np.maximum(words.counts, 1), np.maximum(np.diff(bounds), 1)
        size = np.log2(total).astype(np.int64)
        some = np.flatnonzero(words.counts)
        shares = (8 * own // total, 8 * gram_own // gram_total)
        marks = [size * 16 + shares[0], 1000 + size * 16 + shares[1], 2000 + shares[1]]
        owner = np.concatenate([owner, *(some for _ in marks)])
        keys = np.concatenate([keys, *((mix(m[some].astype(np.uint64)) % U64(BUCKETS)).astype(np.int64) for m in marks)])
        value = np.concatenate([value, np.full(len(marks) * len(some), MARK)])
        order = np.argsort(owner, kind="stable")
        owner, keys, value = owner[order], keys[order], value[order]
        yield np.searchsorted(owner, np.arange(end - first + 1)), keys, value


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    return np.array([len(np.unique(hashes[low:high])) for low, high in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)


def _shape(data: np.ndarray, words: Words) -> np.ndarray:
    """Hash of how a word is written: lengths of its lower, upper, digit and other bytes, each up to 7."""
    kind = np.full(256, 3)
    kind[97:123], kind[128:], kind[65:91], kind[48:58] = 0, 0, 1, 2
    code = np.zeros(len(words.begins), np.uint64)
    classes = kind[data]
    for k in range(4):
        upto = np.concatenate([[0], np.cumsum(classes == k)])
        code = code * U64(8) + np.minimum(upto[words.ends] - upto[words.begins], 7).astype(np.uint64)
    return mix(code)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int) -> Model:
    """Maximum likelihood by steps over shuffled small groups, with one shared weight vector.

    The gradient of a row's log likelihood for grade g is (1 - F_g - F_{g+1}) in the score, where F_j is the
    chance of at least grade j (F_0 = 1, F_last+1 = 0). Thresholds start at the grades' shares and stay in order.
    """
    rng = np.random.default_rng(SEED)
    weights = np.zeros(BUCKETS)
    labels = np.array([r[2] for r in rows], int)
    at_least = np.array([((labels >= j).sum() + 0.5) / (len(labels) + 1.0) for j in range(1, grades)])
    thresholds = -np.log(at_least / (1 - at_least))
    squares = np.full(BUCKETS, 1e-3)
    for turn in range(PASSES):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), STEP_ROWS):
            group = order[first : first + STEP_ROWS]
            keys = np.concatenate([rows[i][0] for i in group])
            values = np.concatenate([rows[i][1] for i in group])
            owner = np.repeat(np.arange(len(group)), [len(rows[i][0]) for i in group])
            scores = np.bincount(owner, weights[keys] * values, len(group))
            tails = Model(weights, thresholds).tails(scores)
            high = np.concatenate([np.ones((len(group), 1)), tails, np.zeros((len(group), 1))], axis=1)
            g, row = labels[group], np.arange(len(group))
            up = 1.0 - high[row, g] - high[row, g + 1]
            slope = np.bincount(keys, up[owner] * values, BUCKETS) / len(group) - DECAY * weights
            squares += slope * slope
            weights += RATE * slope / np.sqrt(squares)
            chance = np.maximum(high[row, g] - high[row, g + 1], 1e-9)
            push = np.zeros(grades - 1)
            inner = high * (1 - high) / chance[:, None]
            np.add.at(push, g[g > 0] - 1, -inner[row, g][g > 0])
            np.add.at(push, g[g < grades - 1], inner[row, g + 1][g < grades - 1])
            thresholds = np.maximum.accumulate(thresholds + RATE / (1 + turn) * push / len(group) / 4)
    return Model(weights, thresholds)


def learn(docs: DataFrame, ratings: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `train_rows` rows of `ratings` (doc_id, grade 0, 1, ...); features are made where the texts are."""
    sample = ratings.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    sample = bounded_sample(sample, train_rows, "doc_id", "grade").dropDuplicates(["doc_id"])
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "grade")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades, at = batch.column("grade").to_pylist(), 0
            for bounds, keys, values in hashed(batch.column("text")):
                n = len(bounds) - 1
                pairs = [(keys[bounds[i] : bounds[i + 1]].astype("<u2").tobytes(), values[bounds[i] : bounds[i + 1]].astype("<f4").tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grades[at : at + n], pa.int32()), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
                    ["grade", "buckets", "weights"])
                at += n

    made = rows.mapInArrow(describe, "grade int, buckets binary, weights binary").toLocalIterator()
    found = [(np.frombuffer(r[1], "<u2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(np.float64), r[0]) for r in made]
    found.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # the same model whatever the order of arrival
    grades = max([1, *(r[2] for r in found)]) + 1
    if not found:
        return Model(np.zeros(BUCKETS), np.zeros(grades - 1))
    return fit(found, grades)


def graded(docs: DataFrame, ratings: DataFrame, train_rows: int = TRAIN_ROWS, keep_grade: int = KEEP_GRADE) -> DataFrame:
    """Grade every text of `docs` (doc_id, text): doc_id, expected_grade, tail_1 .., kept.

    tail_j is the chance of at least grade j; expected_grade is their sum; kept says tail_`keep_grade` >= 0.5. There are
    as many tails as the sample's highest grade (one at least). A null or empty text has no features and gets the
    chances of the thresholds alone. Without ratings every tail is 0.5. Repeated rows are graded alike; null ids are
    graded but not learned from; if ratings repeat an id, one of them counts. Extra columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = learn(docs, ratings, train_rows)
    number = len(model.thresholds)
    names = [f"tail_{j + 1}" for j in range(number)]
    keep_at = min(keep_grade, number) - 1

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for bounds, keys, values in hashed(batch.column("text")):
                n = len(bounds) - 1
                owner = np.repeat(np.arange(n), np.diff(bounds))
                tails = model.tails(np.bincount(owner, model.weights[keys] * values, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, j]) for j in range(number)),
                     pa.array(tails[:, keep_at] >= 0.5)],
                    ["doc_id", "expected_grade", *names, "kept"])
                at += n

    tails = "".join(f"{name} double, " for name in names)
    return docs.mapInArrow(grade, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, {tails}kept boolean")
