"""Toxicity by non-negative positive-unlabelled learning.

Training data are texts confirmed as toxic, and unlabelled texts that hold toxic ones at the rate of
the class prior. A linear model on hashed words and character n-grams is fitted with numpy by the
class-prior-corrected risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

whose second part, the risk on negatives, is kept from going below zero: a step that finds it
negative climbs back instead. An L1 term leaves words without evidence at zero.

Fitting uses bounded samples: MOST_POSITIVE and MOST_UNLABELLED different rows with the least hashes of
id and text, however many rows an id has. Only ids are shuffled to find them. The model keeps the Fit.features
n-grams of 4 to 6 letters, or whole words, that tell the samples apart best. The prior comes from all labelled rows and is
kept between LEAST_PRIOR and MOST_PRIOR. Scoring runs over every whole text and whole word, in tasks that hold
the weights (DIMENSIONS floats) and a bounded table of word scores.

The held-out fold (crc32 of the id as text, modulo FOLDS, is 0) is never read for labels. Nulls and
empty texts score as a text without words; a null id belongs to no fold and is not trained on; a
null label counts as unlabelled. Without a confirmed toxic row all scores are 0. Rows that repeat an
id are scored each. Columns other than key and text are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
MOST_POSITIVE = 1_500
MOST_UNLABELLED = 4_500
DIMENSIONS = 1 << 18
TABLE_WORDS = 400_000
#: Longer words are not kept in the table.
LONG_WORD = 40
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.5
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    features: int = 1_000
    steps: int = 300
    rate: float = 0.05
    sparsity: float = 2e-4
    slack: float = 0.0


def text_words(text: str | None) -> list[str]:
    """The distinct words of a text, in order of first appearance."""
    return list(dict.fromkeys(_WORD.findall(text.lower()))) if text else []


def word_features(word: str) -> list[int]:
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in sorted(grams)]


class Rows:
    """A sparse 0/1 matrix by rows, for products with dense vectors."""

    def __init__(self, lists: list[list[int]]):
        self.columns = np.fromiter((c for x in lists for c in x), np.int32, sum(map(len, lists)))
        self.rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        self.shape = (len(lists), int(self.columns.max(initial=-1)) + 1)

    def only(self, keep: np.ndarray) -> None:
        """Leaves out the other columns and numbers these from 0."""
        number = np.full(self.shape[1], -1, np.int32)
        number[keep] = np.arange(len(keep))
        there = number[self.columns] >= 0
        self.columns, self.rows = number[self.columns[there]], self.rows[there]
        self.shape = (self.shape[0], len(keep))

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=x[self.columns], minlength=self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=y[self.rows], minlength=self.shape[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(docs: Rows, features: Rows, n: int, most: int) -> np.ndarray:
    """The features whose rate differs most between the first n documents and the rest, in standard errors."""
    inside = np.zeros(docs.shape[0])
    inside[:n] = 1
    p, u = (features.back(docs.back(x)) / max(x.sum(), 1) for x in (inside, 1 - inside))
    gap = np.abs(p - u) / np.sqrt((u + 1 / len(inside)) * (1 / max(n, 1)))
    best = np.argsort(-gap, kind="stable")[:most]
    return np.sort(best[gap[best] > 0])


def fit(positive: list[list[str]], unlabelled: list[list[str]], prior: float, how: Fit = Fit()) -> np.ndarray:
    """Weights of the features, the bias last."""
    place: dict[str, int] = {}
    docs = Rows([[place.setdefault(w, len(place)) for w in words] for words in positive + unlabelled])
    features = Rows([word_features(w) for w in place])
    chosen = telling(docs, features, len(positive), how.features)
    features.only(chosen)
    width = len(chosen)
    n = len(positive)
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second, bias_first, bias_second = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, how.steps + 1):
        score = docs.times(features.times(weights)) + bias
        p, u = score[:n], score[n:]
        negative_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        slope = np.zeros(len(score))
        if negative_risk >= -how.slack:
            slope[:n] = prior * (-_sigmoid(-p) - _sigmoid(p)) / n
            slope[n:] = _sigmoid(u) / len(u)
        else:  # climb back
            slope[:n] = prior * _sigmoid(p) / n
            slope[n:] = -_sigmoid(u) / len(u)
        grad, bias_grad = features.back(docs.back(slope)), slope.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        bias_first, bias_second = 0.9 * bias_first + 0.1 * bias_grad, 0.99 * bias_second + 0.01 * bias_grad**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        scale = how.rate / (np.sqrt(second / b) + 1e-4)
        weights -= scale * first / a
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * how.sparsity, 0)
        bias -= how.rate * (bias_first / a) / (np.sqrt(bias_second / b) + 1e-4)
    whole = np.zeros(DIMENSIONS + 1)
    whole[chosen], whole[-1] = weights, bias
    return whole


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled ids, and the confirmed toxic and all texts (id, text), outside the held-out fold."""
    usable = F.crc32(F.col(key).cast("string")) % FOLDS != 0
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(usable)
    marked = labels.where(usable).groupBy(F.col(key).alias("of")).agg(F.max("toxic").alias("toxic"))
    there = texts.select("id").distinct()  # ids only: no text is shuffled
    toxic = marked.where("toxic = 1").join(there, F.col("of") == F.col("id"), "left_semi").select("of")
    ids = F.broadcast(toxic.orderBy(F.xxhash64("of"), "of").limit(MOST_POSITIVE))
    return marked, texts.join(ids, F.col("id") == F.col("of"), "left_semi"), texts


def sample(rows: DataFrame, most: int) -> list[str | None]:
    """Texts of at most `most` different rows (id, text), those with the least hashes.

    A bound on the hash, taken from the number of rows, leaves a few times as many to be ordered; copies of a
    row meet in the tasks before that. Should copies leave too few, the bound is raised.
    """
    total = rows.select("id").count()
    share = min(1.0, 4 * most / max(total, 1))
    while True:
        highest = min(int(share * 2**64) - 2**63, 2**63 - 1)
        near = rows.withColumn("hash", F.xxhash64("id", "text")).where(F.col("hash") <= highest)
        found = near.groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash").limit(most)
        texts = [r.text for r in found.toLocalIterator()]
        if len(texts) == most or share == 1.0:
            return texts
        share = min(1.0, 16 * share)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray | None:
    marked, positive, unlabelled = training_rows(docs, labels, key, text)
    total = marked.agg(F.count("toxic"), F.sum("toxic")).first()
    if not total[1]:
        return None
    prior = min(max(total[1] / total[0], LEAST_PRIOR), MOST_PRIOR)
    p, u = ([text_words(t) for t in sample(rows, n)] for rows, n in ((positive, MOST_POSITIVE), (unlabelled, MOST_UNLABELLED)))
    return fit(p, u, prior) if p and u else None


def score(docs: DataFrame, weights: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table: dict[str, float] = {}

        def of(word: str) -> float:
            found = table.get(word)
            if found is None:
                found = float(model[word_features(word)].sum())
                if len(table) >= TABLE_WORDS:
                    table.clear()
                if len(word) <= LONG_WORD:
                    table[word] = found
            return found

        for batch in batches:
            if model is None:
                scores = np.zeros(len(batch))
            else:
                raw = [sum(map(of, text_words(x.as_py()))) + model[-1] for x in batch.column(1)]
                scores = _sigmoid(np.array(raw, float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, score double")
        .withColumnRenamed("key", key)
    )


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, key, text), key, text)
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select(key, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
