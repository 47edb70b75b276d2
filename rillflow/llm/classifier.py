"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good, outside the held-out fold) and unlabelled texts are two samples of bounded size. A
small network is fitted by the non-negative unbiased risk: with class prior p, the loss of the negatives is estimated as
the unlabelled loss minus p times the positives' loss as negatives, and where that estimate falls below zero its gradient
is reversed instead of followed. The prior itself is estimated first, from a plain positive-against-unlabelled fit: the
least ratio, over thresholds, of the shares of held-back unlabelled and positive rows above it (best bin estimation).

The network sees text statistics only, never labels, language, source or id.

Defined results: null and empty texts score as texts without words; texts are read whole; equal texts get equal scores;
every row gets a score, repeated rows and rows without an id too. Of documents only doc_id and text are read, so extra
columns' names cannot clash. For fitting, an id counts once: as a positive if any of its labels is 1, and with one of its
texts' statistics (the least, in order) where its rows differ; rows without an id are not fitted on. Without positives every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .rules import WORD, base, statistics

#: Texts that the classifier is fitted on: at most so many positives and so many unlabelled ones (smallest id hashes).
SAMPLE_ROWS = 6000
THRESHOLD = 0.7
HIDDEN = 24


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


class Network:
    """One hidden layer over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self.norm(x)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3], h, z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(np.asarray(x, dtype=np.float64))[0]))

    def gradient(self, x: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of sum(weight * margin)."""
        _, h, z = self.margin(x)
        dh = weight[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(axis=0), h.T @ weight, weight.sum(keepdims=True)]


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 3) -> Network:
    """By the non-negative PU risk with this prior, or, without one, positives against unlabelled rows."""
    both = np.concatenate([pos, unl])
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-6)
    rng = np.random.default_rng(seed)
    m, v, k = [0 * x for x in net.w], [0 * x for x in net.w], 0
    for epoch in range(epochs):
        for at in range(0, len(unl), batch):
            u = unl[rng.integers(0, len(unl), batch)]
            p = pos[rng.integers(0, len(pos), batch)]
            sp, su = _sigmoid(net.margin(p)[0]), _sigmoid(net.margin(u)[0])
            if prior is None:
                g = [a + b for a, b in zip(net.gradient(p, (sp - 1) / batch), net.gradient(u, su / batch))]
            else:
                # logistic loss as negative: -log(1 - s), gradient s; as positive: -log(s), gradient s - 1
                negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
                part = [a - b for a, b in zip(net.gradient(u, su / batch), net.gradient(p, prior * sp / batch))]
                if negative < 0:
                    g = [-x for x in part]
                else:
                    g = [a + b for a, b in zip(part, net.gradient(p, prior * (sp - 1) / batch))]
            k += 1
            now = rate * (0.1 if epoch > 0.7 * epochs else 1)
            for i, x in enumerate(g):
                x = x + 1e-4 * net.w[i]
                m[i] = 0.9 * m[i] + 0.1 * x
                v[i] = 0.99 * v[i] + 0.01 * x * x
                net.w[i] = net.w[i] - now * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from halves that a plain fit has not seen."""
    net = fit(pos[::2], unl[::2], None, epochs=20)
    p, u = np.sort(net.score(pos[1::2])), np.sort(net.score(unl[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 0.95, 96))
    above = lambda x: (len(x) - np.searchsorted(x, cuts, side="left")) / len(x)
    q_p, q_u = above(p), above(u)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(((q_u + slack) / np.maximum(q_p, 1e-9)).argmin())
    return float(np.clip(q_u[best] / q_p[best], 0.05, 0.98))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                words = WORD.findall(text or "")
                out.append(statistics(text or "", words, base(text or "", words)))
            yield {"doc_id": b["doc_id"], "x": out}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network fitted on at most sample_rows positives and as many unlabelled texts, none of the held-out fold."""
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    order = [F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id")]
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out() & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(*order).limit(sample_rows)
    # ids below a share of the hash's range, about four times as many as are taken: only these are told apart
    share = min(1.0, 4 * sample_rows / max(1, docs.count()))
    low = F.xxhash64(F.lit(18), "doc_id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    unknown = free.where(low).distinct().orderBy(F.xxhash64(F.lit(18), "doc_id"), "doc_id").limit(sample_rows)
    # both samples are bounded by their parameter, so their ids may be broadcast
    side = known.withColumn("p", F.lit(True)).unionByName(unknown.withColumn("p", F.lit(False)))
    chosen = side.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("only"))
    seen = _features(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    # one row for each id, however often it comes: 2 * sample_rows rows at most reach the driver
    rows = seen.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    pos = np.array([r.x for r in rows if r.p], dtype=np.float64)
    unl = np.array([r.x for r in rows if not r.only], dtype=np.float64)
    if len(pos) < 4 or len(unl) < 4:
        return None
    return fit(pos, unl, estimate_prior(pos, unl))


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every text."""

    def run(batches):
        for b in batches:
            x = []
            for text in b["text"]:
                words = WORD.findall(text or "")
                x.append(statistics(text or "", words, base(text or "", words)))
            s = net.score(np.array(x)) if net and x else np.full(len(x), 0.5)
            yield {"doc_id": b["doc_id"], "score": s.tolist(), "predicted": [int(v >= threshold) for v in s.tolist()]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
