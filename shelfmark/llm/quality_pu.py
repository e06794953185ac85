"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents that a label marks as good; the model minimises
the non-negative unbiased risk (Kiryo et al., Positive-Unlabeled Learning with Non-Negative Risk Estimator, 2017)

    prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])

with the logistic loss over an additive model: each measure of a text is cut into quantile bins, each bin has a weight.
Where the second term falls below zero on a batch, the step goes against its gradient.

No negative label is used anywhere: a document marked bad counts as unlabelled text like every other one, and so does a
document marked good when it comes up in the unlabelled sample.

The class prior is estimated from the positives and the unlabelled text (Garg et al., Mixture Proportion Estimation and PU
Learning: A Modern Approach, 2021): a model that tells positives from unlabelled text is fitted on each half and scores the
other; the prior is the least ratio, over all thresholds, of unlabelled to positive texts above the threshold, with an
allowance for small counts, so few labels make it too large rather than too small. The scores are scaled to probabilities by the two numbers that minimise the unbiased risk;
with the logistic loss that is a convex problem in positives and unlabelled text only.

The fit uses a bounded sample of the training fold: at most ``SAMPLE`` positives and ``SAMPLE`` documents of any kind, those
with the least hash of their id. Measures and scores are computed for all documents, whole texts.

Defined results: null and empty texts have measures of zero and are scored like any other. Repeated labels of a document
count as good if any says so. Without positives all scores are 0.5. Rows keep their number; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fold, one_table, texts

SAMPLE = 12_000
BINS = 16
EPOCHS = 30
BATCH = 512
RATE = 0.05
THRESHOLD = 0.3
SEED = 7
RIDGE = 0.001
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGNS = ("!", "#*$%&|<>", "0123456789", ".,;:?", "\"'()[]{}", "=@/\\_~^+")
MEASURES = 16


def measure(text: str) -> list[float]:
    """Numbers that describe a text's form; none of them depends on its language or topic."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * MEASURES
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode()
    signs = [sum(raw.count(c.encode()) for c in group) / chars for group in _SIGNS]
    upper = (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
             if text.isascii() else len(_UPPER.findall(text)))
    return [float(np.log1p(n)), (chars - n) / n, len(counts) / n, counts.most_common(1)[0][1] / n,
            sum(a == b for a, b in pairwise(words)) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
            upper / chars, max(map(len, words)), sum(map(str.isalpha, words)) / n, *signs]


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, role) of at most ``size`` documents marked good (role 1) and ``size`` documents of any kind (role 0)."""
    good = (labels.where("doc_id IS NOT NULL AND quality = 1").where(fold(F.col("doc_id")) != 0)
            .select(F.col("doc_id").alias("label_id")).distinct())
    ids = (docs.where("doc_id IS NOT NULL").select("doc_id").where(fold(F.col("doc_id")) != 0).distinct()
           .select(F.col("doc_id").alias("chosen"), F.xxhash64("doc_id").alias("order")))
    positive = ids.join(good, F.col("chosen") == F.col("label_id"), "left_semi")
    parts = [part.orderBy("order", "chosen").limit(size).select("chosen", F.lit(role).alias("role"))
             for role, part in ((1, positive), (0, ids))]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * size narrow rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text", "role")


class Model:
    """An additive model over quantile bins."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Index of the weight of every measure: rows x measures."""
        found = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)
        return found + np.arange(x.shape[1]) * (self.edges.shape[1] + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[self.bins(x)].sum(axis=1) + self.bias)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model:
    """Stochastic descent on the non-negative risk, with the step sizes of Adam."""
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:], axis=0).T if len(both) else np.zeros((MEASURES, BINS))
    model = Model(edges, np.zeros(MEASURES * (BINS + 1)), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0)
    if not len(positive) or not len(unlabelled):
        return model
    bp, bu = model.bins(positive), model.bins(unlabelled)
    rng = np.random.default_rng(seed)
    size = len(model.weights)
    w = np.zeros(size + 1)
    mean, square, step = np.zeros(size + 1), np.zeros(size + 1), 0

    def margin(b: np.ndarray) -> np.ndarray:
        return w[b].sum(axis=1) + w[size]

    def spread(b: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(b.ravel(), np.repeat(g, b.shape[1]), size + 1)
        out[size] = g.sum()
        return out

    mixed = np.zeros(size + 1)  # the weights averaged over the second half
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bu))
        for start in range(0, len(order), BATCH):
            u, p = bu[order[start:start + BATCH]], bp[rng.integers(0, len(bp), BATCH)]
            fp, fu = margin(p), margin(u)
            down = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            up_p, up_u = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = spread(u, up_u / len(u)) - prior * spread(p, up_p / len(p))
            grad = prior * spread(p, (up_p - 1) / len(p)) + negative if down >= 0 else -negative
            grad = grad + 1e-4 * w
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad ** 2
            w = w - RATE * (1 - epoch / EPOCHS) * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        if epoch >= EPOCHS // 2:
            mixed += w / (EPOCHS - EPOCHS // 2)
    return Model(edges, mixed[:size], float(mixed[size]))


def separate(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150) -> Model:
    """An additive model that tells positives from unlabelled text, both sides weighing the same."""
    both = np.concatenate([positive, unlabelled])
    model = Model(np.quantile(both, np.linspace(0, 1, BINS + 1)[1:], axis=0).T, np.zeros(MEASURES * (BINS + 1)), 0.0)
    at = model.bins(both)
    mark = np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
    weight = np.repeat([0.5 / len(positive), 0.5 / len(unlabelled)], [len(positive), len(unlabelled)])
    w = model.weights
    for step in range(rounds):
        gap = (1 / (1 + np.exp(-w[at].sum(axis=1))) - mark) * weight
        w = w - 4.0 * (np.bincount(at.ravel(), np.repeat(gap, at.shape[1]), len(w)) + 1e-2 * w)
    return Model(model.edges, w, 0.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, see the top. 0.5 when one side is too small to be halved."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    models = [separate(positive[k::2], unlabelled[k::2]) for k in (0, 1)]  # each scores the other half
    p, u = (np.sort(np.concatenate([models[k].score(x[1 - k::2]) for k in (0, 1)])) for x in (positive, unlabelled))
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = np.argmin((share_u + slack) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def calibrate(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 50,
              ridge: float = RIDGE) -> Model:
    """Scales the margins: the slope a and shift b of least unbiased risk, mean_u log(1 + e^(af+b)) - prior mean_p (af+b),

    plus ridge / 2 ((a - 1)^2 + b^2), as the risk of a sample has no least value where a model tells it apart too well.
    """
    if not len(positive) or not len(unlabelled):
        return model
    fp, fu = (model.weights[model.bins(x)].sum(axis=1) + model.bias for x in (positive, unlabelled))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a * fu + b, -30, 30)))
        v = q * (1 - q)
        g = np.array([(q * fu).mean() - prior * fp.mean() + ridge * (a - 1), q.mean() - prior + ridge * b])
        h = np.array([[(v * fu ** 2).mean() + ridge, (v * fu).mean()], [(v * fu).mean(), v.mean() + ridge]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return Model(model.edges, model.weights * max(a, 0.0), float(model.bias * max(a, 0.0) + b))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Prior, fit and scale from positives and unlabelled text of the training fold."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for roles, column in one_table(batches, ["role", "text"]):
            found = [measure(text) for text in texts(column)]
            yield pa.RecordBatch.from_arrays([roles, pa.array(found, pa.list_(pa.float64()))],
                                             names=["role", "measures"])

    found = sample(docs, labels, size).mapInArrow(scan, "role int, measures array<double>").toPandas()  # 2 * size rows
    x = np.array(found["measures"].tolist(), dtype=float).reshape(-1, MEASURES)
    order = np.lexsort(x.T)  # rows come in any order
    x, role = x[order], found["role"].to_numpy(dtype=int)[order]
    rng = np.random.default_rng(SEED)
    positive, unlabelled = (rng.permutation(x[role == k]) for k in (1, 0))
    prior = class_prior(positive, unlabelled)
    return calibrate(fit(positive, unlabelled, prior), positive, unlabelled, prior)


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels, size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, column in one_table(batches, ["doc_id", "text"]):
            x = np.array([measure(text) for text in texts(column)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(x))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
