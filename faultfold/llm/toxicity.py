"""Operator 6: toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text learns from confirmed toxic texts (P) and unlabelled
texts (U) only. With class prior ``pi`` the risk is ``pi * R_P(+) + max(0, R_all(-) - pi * R_P(-))``: the
part for the negatives is what all texts show once their share of positives is taken away, and it is
kept from going below zero, or a flexible model would drive it there. When it does go below, the step is
taken against it, as in the published method. U leaves the confirmed texts out, so where these are a
share ``rho`` of all, ``R_all(-)`` is ``(1 - rho) * R_U(-) + rho * R_P(-)``; with all toxic texts confirmed
that is plain supervised learning. A step that shrinks small weights to zero keeps rare chance words out
of the model.

Training runs on the driver over a bounded sample (``MOST_POSITIVE``, ``MOST_UNLABELLED`` texts, as
arrays of distinct hashed words); scoring reads every whole text in one pass, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bounds of the training sample, in texts. The class prior is counted over all labelled rows.
MOST_POSITIVE = 3000
MOST_UNLABELLED = 9000
#: Beginnings of words that are features beside the words, so that inflected forms share weight.
PREFIXES = (4, 5, 6)
#: A feature has to be so many times as frequent in P as in U, or half as many times as a pure sign of the
#: class can be, which is one over the prior; but always a little more frequent.
LIFT, LEAST_LIFT = 4.0, 1.2
THRESHOLD = 0.7

_TOKEN = re.compile(r"[^\W_]+")


def hashed_words(text: str | None) -> np.ndarray:
    """Distinct hashed features of a text, sorted: its words (letters and digits, lower case), and
    their beginnings."""
    found = set(_TOKEN.findall((text or "").lower()))
    hashes = {zlib.crc32(w.encode()) for w in found}
    for n in PREFIXES:
        hashes.update([zlib.crc32(w.encode(), n) for w in {w[:n] for w in found if len(w) > n}])
    return np.sort(np.fromiter(hashes, np.uint32, len(hashes)))


@dataclass
class ToxicModel:
    """Weights of the hashed words that matter, by ascending hash, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Between 0 and 1; a text without words gets the score of the bias alone."""
        own = hashed_words(text)
        z = self.bias
        if len(own) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            z += float(self.weights[at][self.hashes[at] == own].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _csr(rows: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every word of the vocabulary."""
    at_row, at_col = [], []
    for i, r in enumerate(rows):
        if not len(r) or not len(vocabulary):
            continue
        at = np.minimum(np.searchsorted(vocabulary, r), len(vocabulary) - 1)
        at = at[vocabulary[at] == r]
        at_row.append(np.full(len(at), i, np.int32))
        at_col.append(at.astype(np.int32))
    if not at_row:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(at_row), np.concatenate(at_col)


def least_lift(prior: float) -> float:
    return max(LEAST_LIFT, min(LIFT, 0.5 / prior))


def risk(
    w: np.ndarray, positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float, confirmed: float = 0.0
) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk of weights ``w`` (the bias last), for the positives and the negatives, and
    their gradients. Texts are (row, column) of their features and a number of rows."""
    v = len(w) - 1

    def probability(rows, cols, n):
        return 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + w[v], -30, 30)))

    def gradient(rows, cols, slope):
        return np.append(np.bincount(cols, slope[rows], v), slope.sum())

    (pr, pc, n_p), (ur, uc, n_u) = positive, unlabelled
    p, u = probability(*positive), probability(*unlabelled)
    share, rest = 1 - min(confirmed, prior), prior - min(confirmed, prior)
    above = -prior * np.log(np.maximum(p, 1e-12)).mean()
    below = -share * np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + rest * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
    g_pos = gradient(pr, pc, prior * (p - 1) / n_p)
    g_neg = gradient(ur, uc, share * u / n_u) - gradient(pr, pc, rest * p / n_p)
    return float(above), float(below), g_pos, g_neg


def fit_nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    confirmed: float = 0.0,
    steps: int = 400,
    rate: float = 0.05,
    shrink: float = 0.0002,
    least_rows: int = 3,
) -> ToxicModel:
    """Minimise the non-negative risk with the logistic loss by Adam with a shrinking step.

    ``prior`` is the share of toxic among all texts, ``confirmed`` that of the texts known to be. Features
    are screened first: those found in ``least_rows`` positive texts and :func:`least_lift` times as
    often there as in the unlabelled ones.

    Without positive or unlabelled texts there is nothing to learn: the model scores the prior.
    """
    prior = float(min(max(prior, 1e-4), 1 - 1e-4))
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return ToxicModel(np.empty(0, np.uint32), np.empty(0), start)
    found, in_p = np.unique(np.concatenate(positive), return_counts=True)
    _, at = _csr(unlabelled, found)
    in_u = np.bincount(at, minlength=len(found))
    least = max(min(least_rows, len(positive)), 0.003 * len(positive))
    lift = least_lift(prior)
    vocabulary = found[(in_p >= least) & (in_p / len(positive) >= lift * in_u / len(unlabelled))]
    (pr, pc), (ur, uc) = _csr(positive, vocabulary), _csr(unlabelled, vocabulary)
    n_p, n_u, v = len(positive), len(unlabelled), len(vocabulary)
    w, b = np.zeros(v + 1), start
    w[v] = b
    first, second = np.zeros(v + 1), np.zeros(v + 1)

    for step in range(1, steps + 1):
        _, negative, g_pos, g_neg = risk(w, (pr, pc, n_p), (ur, uc, n_u), prior, confirmed)
        g = -g_neg if negative < 0 else g_pos + g_neg
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        scale = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-5)
        w -= scale * first / (1 - 0.9**step)
        w[:v] = np.sign(w[:v]) * np.maximum(0, np.abs(w[:v]) - np.minimum(scale[:v], 50.0) * shrink)
    keep = np.abs(w[:v]) > 1e-3
    return ToxicModel(vocabulary[keep], w[:v][keep], float(w[v]))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sample(docs: DataFrame, ids: DataFrame, limit: int) -> list[np.ndarray]:
    """Hashed words of at most ``limit`` texts, those with the smallest hashes of their ids."""
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [hashed_words(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "words"])

    # At most ``limit`` ids are broadcast, whatever the size of the table.
    rows = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = rows.mapInArrow(run, "doc_id long, words binary").orderBy("doc_id")
    return [np.frombuffer(bytes(r["words"]), np.uint32) for r in rows.toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learn from rows that are not held out: P are those labelled toxic, U any texts not in P.

    The prior is the share of toxic among all labelled rows that are not held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~is_held_out(F.col("doc_id")))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    labels = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    seen = labels.agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first()["prior"]
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    ids = docs.select("doc_id").distinct()
    counted = ids.join(toxic.withColumn("p", F.lit(1)), "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("p")).first()
    other = ids.join(toxic, "doc_id", "left_anti")
    positive, unlabelled = _sample(docs, toxic, MOST_POSITIVE), _sample(docs, other, MOST_UNLABELLED)
    confirmed = counted["p"] / counted["n"] if counted["n"] else 0.0
    return fit_nnpu(positive, unlabelled, 0.05 if seen is None else seen, confirmed)


def with_score(docs: DataFrame, model: ToxicModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    rest = [c for c in docs.columns if c != name]
    texts = docs.select(*[F.col(f"`{c}`") for c in rest])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [model.score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])

    schema = StructType([*texts.schema.fields, StructField(name, DoubleType())])
    return texts.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) after training on ``labels`` (doc_id, toxic).

    Columns: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on).

    Cases: null and empty texts score as the bias; rows with a null doc_id are scored and count as
    held out; null labels teach nothing; repeated rows are scored alike; without labels every text
    gets the prior; an empty table gives no rows; other columns are left out.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
