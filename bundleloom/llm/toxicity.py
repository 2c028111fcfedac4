"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained with numpy from confirmed toxic texts (P) and unlabelled
texts (U) by the class-prior-corrected risk ``prior*R_p(+) + max(0, R_u(-) - prior*R_p(-))``; when the
corrected negative part falls below zero its gradient is reversed, as in the published method.

The fit uses bounded samples (``max_positive``, ``max_unlabelled``: the rows with the smallest seeded hash of their
id), P of the confirmed toxic texts and U of all texts of the training fold, confirmed ones among them, as the
risk supposes.  A hashed word gets a weight if the two samples tell it apart (four standard errors, four texts);
scoring reads every whole text.  Only ids, texts and the training labels are read.

Defined cases: null or empty texts have no words and get the score of the bias; a null id is never held
out and never trained on; several labels of one id count as toxic if any is; repeated rows are scored
alike; without any confirmed toxic text every score is 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import give_back, map_rows, per_batch, seeded

BUCKETS = 1 << 20
THRESHOLD = 0.7
#: Words whose weights a task keeps at hand.
REMEMBERED = 100_000
TOKEN = re.compile(r"[^\W_]+")


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) & (BUCKETS - 1)


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a whole text."""
    return set(TOKEN.findall(text.lower())) if text else set()


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never trained on: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Weights by bucket, and a bias.  At most ``BUCKETS`` weights, of words that stand in the bounded samples."""

    def __init__(self, weights: dict[int, float], bias: float | None):
        self.weights, self.bias, self.seen = weights, bias, {}

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        if self.bias is None:
            return 0.0
        seen, parts = self.seen, [self.bias]
        for w in words_of(text):
            v = seen.get(w)
            if v is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                v = self.weights.get(bucket(w), 0.0)
                if len(w) < 64:
                    seen[w] = v
            if v:
                parts.append(v)
        total = math.fsum(parts)  # the same in any order
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, total)))))

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.weights, self.bias = state
        self.seen = {}


def fit(positive: list, unlabelled: list, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Train from the buckets of each sampled text (lists of integer arrays)."""
    if not positive or not unlabelled:
        return Model({}, None)
    lens = np.array([len(x) for x in positive] + [len(x) for x in unlabelled])
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in [*positive, *unlabelled]])
    n_p, n_u = len(positive), len(unlabelled)
    cut = int(lens[:n_p].sum())
    in_p, in_u = np.bincount(flat[:cut], minlength=BUCKETS), np.bincount(flat[cut:], minlength=BUCKETS)
    best = np.flatnonzero(in_p + in_u >= 4)
    in_p, in_u = in_p[best], in_u[best]
    mean = (in_p + in_u) / (n_p + n_u)
    spread = np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u)) + 1e-12
    best = best[np.abs(in_p / n_p - in_u / n_u) / spread > 4]
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[best] = np.arange(len(best))
    row, col = np.repeat(np.arange(len(lens), dtype=np.int32), lens), place[flat]
    row, col = row[col >= 0], col[col >= 0]
    del flat, place
    w, bias = np.zeros(len(best)), float(np.log(prior / (1 - prior)))
    moment, second = np.zeros(len(best) + 1), np.zeros(len(best) + 1)

    def back(g):
        return np.append(np.bincount(col, weights=g[row], minlength=len(best)), g.sum())

    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=n_p + n_u) + bias, -60, 60)))
        loss_neg = -np.log(np.maximum(1 - s, 1e-12))
        rest = loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean()
        up, down = np.zeros(n_p + n_u), np.zeros(n_p + n_u)
        up[:n_p] = prior * (s[:n_p] - 1) / n_p
        down[n_p:] = s[n_p:] / n_u
        down[:n_p] = -prior * s[:n_p] / n_p
        grad = back(up + down) if rest >= 0 else back(-down)
        grad[:-1] += decay * w
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model({int(b): float(v) for b, v in zip(best, w) if abs(v) > 1e-6}, bias)


def _lowest(ids: DataFrame, rows: int, most: int, seed: int) -> DataFrame:
    """The ``most`` rows with the smallest seeded hash of ``id``.

    A bound on the hash, from the number of rows, leaves some four times as many before they are sorted, so
    that what meets in one task depends on ``most`` and not on the number of partitions.
    """
    mark = seeded(seed, F.col("id"))
    share = min(1.0, (4 * most + 100) / max(1, rows))
    near = ids if share == 1.0 else ids.filter(mark < int(-(2**63) + share * 2**64))
    return near.orderBy(mark, "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 9000, seed: int = 11) -> Model:
    """Fit on bounded samples of the training fold: confirmed toxic texts, and texts of any label or none."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter(~held_out(F.col("id"))).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = marked.agg(F.count("*"), F.sum("toxic")).first()
    if not counts[0] or not counts[1]:
        return Model({}, None)
    prior = min(0.5, max(0.001, counts[1] / counts[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    chosen_p = _lowest(marked.filter("toxic = 1"), counts[1], max_positive, seed).select("id", F.lit(1).alias("p"))
    ids = texts.select("id").filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen_u = _lowest(ids, docs.count() * 2 // 3, max_unlabelled, seed).select("id", F.lit(0).alias("p"))
    chosen = F.broadcast(chosen_p.unionByName(chosen_u).distinct())  # at most max_positive + max_unlabelled ids

    def batch(ps, texts):
        rows = [sorted({bucket(w) for w in words_of(t)}) for t in texts]
        return pa.RecordBatch.from_arrays([ps, pa.array(rows, pa.list_(pa.int32()))], ["p", "buckets"])

    got = texts.join(chosen, "id").select("p", "text").mapInArrow(per_batch(batch), "p int, buckets array<int>").toArrow()
    sides: dict = {1: [], 0: []}
    for p, b in zip(got["p"].to_pylist(), got["buckets"]):
        sides[p].append(b.values.to_numpy())
    order = lambda x: sorted(x, key=lambda a: (len(a), xxhash.xxh64_intdigest(a)))  # noqa: E731  so that reruns agree
    model = fit(order(sides[1]), order(sides[0]), prior)
    del got, sides
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; the model is a bounded set of weights carried with the task."""

    def batch(ids, texts):
        return pa.RecordBatch.from_arrays([ids, pa.array([model.score(t) for t in texts], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(per_batch(batch), "id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train, then score and judge every document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    out = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", out)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    model = train(docs, labels)

    def run(part, texts):
        return part.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return map_rows(docs, text_col, run).toDF(*docs.columns)
