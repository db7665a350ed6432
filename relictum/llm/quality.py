"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian; its covariance is shrunk towards the pooled one and towards a multiple of the identity. The fit
needs only counts, sums and cross products of a bounded sample of labelled rows, which Spark adds up; no row reaches the
driver. A score
is the posterior from the difference of two Mahalanobis log densities; inverse Cholesky factors are computed once.

Defined cases: null and empty texts have the statistics of the empty text and a score like any other; labels other than 0
and 1, ids whose labels disagree and null ids are left out of the fit; of rows that share an id one counts in it; with one class only, or none, every score is that class's smoothed share;
repeated rows score alike; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import drawn_labels, drawn_rows, text_udf

SYMBOLS = np.frombuffer(b"#$%&*<>=@^_~\\{}[]", np.uint8)
FEATURES = 16


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text; shares enter by their square roots, sizes by their logarithms."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    w = max(1, len(words))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    p = count[count > 0] / n
    kinds = len(set(words))
    share = lambda x: float(np.sqrt(x / n))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / w)),
        float(np.sqrt(upper / max(1, upper + lower))),
        share(int(count[SYMBOLS].sum())),
        share(int(count[ord("|")])),
        share(int(count[ord("!")] + count[ord("?")])),
        share(int(count[48:58].sum())),
        share(int(count[ord(".")] + count[ord(",")] + count[ord(";")])),
        share(int(count[128:].sum())),
        share(int(count[32] + count[9])),
        float(np.log1p(kinds) / np.log1p(w)),
        float(1 - len(set(lines)) / max(1, len(lines))),
        float(np.log1p(len(words) / max(1, len(lines)))),
        float(-(p * np.log2(p)).sum()) if len(data) else 0.0,
        float(np.sqrt(sum(len(x) <= 3 for x in words) / w)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """`whiten[k] @ (x - mean[k])` has the identity as covariance in class k; offset[k] is its log prior less its log volume."""

    prior: float
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offset: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        density = [o - 0.5 * np.square((x - m) @ w.T).sum(1) for m, w, o in zip(self.mean, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of one task: the sums of 1, of x and of x x' of its texts, as (class, place, sum)."""
    total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for batch in batches:
        x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, FEATURES)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    k, i = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(total[k, i])], names=["k", "i", "total"])


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", text_col: str = "text", sample_rows: int = 50_000, shrink_pooled: float = 0.1, shrink_identity: float = 0.02) -> Discriminant:
    """Learn from about `sample_rows` labelled ids of each class outside the held-out fifth, or all where there are fewer; only
    their texts are described. Each row is weighed by the share of its class that was drawn."""
    drawn, _, share = drawn_labels(labels, label_col, sample_rows)
    rows = drawn_rows(docs, drawn, text_col).select("text", "y")
    sums = rows.mapInArrow(moments, "k int, i int, total double").groupBy("k", "i").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for r in sums:
        total[r.k, r.i] = r.total
    total /= np.array(share)[:, None]
    n = total[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2))
    if min(total[:, 0] * share) < 2:
        return Discriminant(prior)
    mean = total[:, 1 : 1 + FEATURES] / n[:, None]
    scatter = total[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES) - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    whiten, offset = [], []
    for k in (0, 1):
        own, common = (s / scale[:, None] / scale[None, :] for s in (scatter[k] / n[k], pooled))
        cov = (1 - shrink_pooled - shrink_identity) * own + shrink_pooled * common
        cov += (shrink_identity * np.trace(own) / FEATURES + 1e-4) * np.eye(FEATURES)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor) / scale[None, :])
        offset.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(prior, mean, np.array(whiten), np.array(offset))


def score_quality(docs: DataFrame, model: Discriminant, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the probability of label 1."""

    def run(texts: list[str]) -> pa.Array:
        return pa.array(model.scores(np.array([statistics(x) for x in texts], float).reshape(-1, FEATURES)), pa.float64())

    return docs.withColumn(score_col, text_udf(run, "double")(F.col(text_col)))
