"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; the unlabelled texts are web text whose labels are not
looked at. With the class prior p, the risk of a scorer g over loss l is p E_pos[l(g)] plus the
negatives' risk, which the unlabelled texts give as E_unl[l(-g)] - p E_pos[l(-g)]. That difference
cannot be negative in truth, so where an estimate falls below zero the gradient step takes it back
up instead (the non-negative estimator). The prior is the share of good labels among the labels
that may be learnt from, smoothed by one label of each kind.

g is additive over ten bins of each of the text's statistics (shares of kinds of characters,
repetition, lengths), which come from the whole text; bin edges are quantiles of the sample.

Cases: a null text counts as empty and is scored like one; documents with a null id are never learnt
from; an id of several rows or labels is drawn once, with its least text; every row is scored. Without
any positive label every score is the prior.
Other columns pass unchanged; a column named like a result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.support import fresh

#: Bounds of the two samples that the model is fitted on, in documents.
POSITIVES, UNLABELLED = 20_000, 20_000
BINS, STEPS, RATE, DECAY = 10, 400, 0.1, 1e-4

_KINDS = np.zeros(256, "i8")
for _kind, _signs in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|",
     b"#*$%&<>", b"!?", b".", b",;:", b"\"'`", b"/@_=~^+-", b"()[]{}", b" \t\r", b"\n"), 1
):
    _KINDS[list(_signs)] = _kind
_KINDS[128:] = 14
N_KINDS = 15


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text."""
    data = np.frombuffer(text.encode(), "u1")
    kinds = np.bincount(_KINDS[data], minlength=N_KINDS)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m, size = max(1, len(words)), max(1, len(lines)), max(1, len(data))
    counts = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    longest = max(map(len, words), default=0)
    return np.array(
        [
            *(kinds / size),
            np.log1p(len(data)),
            np.log1p(len(words)),
            len(text) / n,
            longest,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            again / n,
            1 - triples / max(1, len(words) - 2),
            1 - len(set(lines)) / m,
            n / m,
            sum(map(str.istitle, words)) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isalpha, words)) / n,
        ]
    )


@dataclass
class Scorer:
    """Bin edges per statistic, weights per bin, and the offset."""

    edges: np.ndarray
    weights: np.ndarray
    offset: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1
        ) + np.arange(x.shape[1]) * (BINS + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-(self.weights[self.bins(x)].sum(1) + self.offset)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Minimise the non-negative risk with the logistic loss by full-batch Adam steps."""
    both = np.concatenate([positive, unlabelled])
    width = both.shape[1]
    edges = np.quantile(both, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    scorer = Scorer(edges, np.zeros(width * (BINS + 1)), float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled):
        return scorer
    at_p, at_u = scorer.bins(positive), scorer.bins(unlabelled)
    theta = np.append(scorer.weights, scorer.offset)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        each = np.repeat(slope, width) / len(at)
        return np.append(np.bincount(at.reshape(-1), each, len(theta) - 1), slope.mean())

    for step in range(1, STEPS + 1):
        g_p = theta[at_p].sum(1) + theta[-1]
        g_u = theta[at_u].sum(1) + theta[-1]
        s_p, s_u = 1 / (1 + np.exp(-g_p)), 1 / (1 + np.exp(-g_u))
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        of_negative = gradient(at_u, s_u) - prior * gradient(at_p, s_p)
        if negative >= 0:
            slope = prior * gradient(at_p, s_p - 1) + of_negative
        else:
            slope = -of_negative
        slope[:-1] += DECAY * theta[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Scorer(edges, theta[:-1], float(theta[-1]))


def is_held_out(doc_id: Column) -> Column:
    """The third of documents that nothing is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """Fit on bounded samples, chosen by a hash of the id, outside the held-out third.

    Distinct labelled ids and unlabelled ids are drawn from narrow columns first; only the drawn documents'
    texts are read, one a drawn id (the least, where an id repeats), and their statistics come to the
    driver (at most 40,000 short rows).
    """
    usable = labels.select(F.col("doc_id").alias("id"), "quality").where(
        "id is not null and quality is not null"
    )
    usable = usable.where(~is_held_out(F.col("id")))
    good, bad = usable.agg(
        F.count(F.when(F.col("quality") == 1, 1)), F.count(F.when(F.col("quality") != 1, 1))
    ).first()
    prior = (good + 1) / (good + bad + 2)
    ids = docs.select(F.col(doc_id).alias("id")).where("id is not null")
    ids = ids.where(~is_held_out(F.col("id")))
    order = [F.xxhash64(F.col("id")), F.col("id")]
    positive = usable.where("quality = 1").select("id", F.lit(1).alias("kind"))
    drawn = positive.distinct().orderBy(*order).limit(POSITIVES).unionByName(
        ids.select("id", F.lit(0).alias("kind")).distinct().orderBy(*order).limit(UNLABELLED)
    )
    rows = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(drawn), "id")
        .groupBy("id", "kind")
        .agg(F.min("text").alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("kind"), pa.array(found, pa.list_(pa.float64()))],
                ["id", "kind", "x"],
            )

    kind = T.StructType(
        [
            T.StructField("id", drawn.schema["id"].dataType),
            T.StructField("kind", T.IntegerType()),
            T.StructField("x", T.ArrayType(T.DoubleType())),
        ]
    )
    sample = rows.select("id", "kind", "text").mapInArrow(run, kind).toArrow().sort_by("id")
    x = np.array(sample["x"].to_pylist(), float).reshape(-1, len(statistics("")))
    taken = sample["kind"].to_numpy() == 1
    if not taken.any() or taken.all():
        flat = np.zeros((1, x.shape[1]))
        return fit(flat[:0], flat, prior)
    return fit(x[taken], x[~taken], prior)


def score(df: DataFrame, scorer: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that a text is good, from its whole text."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts):
        rows = [statistics(t or "") for t in texts]
        import pandas as pd

        return pd.Series(scorer.scores(np.array(rows).reshape(len(rows), -1)))

    return df.withColumn(name, scored(F.col(text)))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good."""
    name = fresh("quality_score", docs.columns)
    scored = score(docs, train(docs, labels), name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)
