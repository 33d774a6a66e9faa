r"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are runs of word characters and runs of other marks. Features are hashed uni- and bigrams of lower-cased tokens,
and bi- and trigrams of token shapes (case, digits, marks, whether a token repeats the one before), as counts scaled to
unit length for each kind. A score is the sparse dot product of features and weights. Training takes a bounded sample of
labelled documents in one task; its size is a parameter.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, map_texts, table

#: Labelled documents to learn from, at most about so many, and code points of them all.
TRAIN_DOCS, TRAIN_CHARS = 12_000, 60_000_000
DIM = 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.05, 3
TOKEN = re.compile(r"\w+|[^\w\s]+")


@cache
def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 4
    if token.isdigit():
        return 3
    return 2 if token.isupper() and len(token) > 1 else 1 if token[0].isupper() else 0


class Tokens(dict):
    """Hash and shape of a token, remembered for a bounded number of tokens."""

    def __missing__(self, token: str) -> int:
        value = (zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 3) | _shape.__wrapped__(token)
        if len(self) < 500_000:
            self[token] = value
        return value


def features(text: str | None, memo: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their values."""
    tokens = np.array([memo[t] for t in TOKEN.findall(text or "")], np.int64)
    if not len(tokens):
        return np.array([0]), np.array([1.0])
    word, shape = tokens >> 3, tokens & 7
    shape = shape + 8 * np.r_[False, word[1:] == word[:-1]]
    kinds = [word * 2654435761 + 1, (word[1:] * 40503 + word[:-1] * 2654435761) + 2, (shape[1:] * 16 + shape[:-1]) * 7919 + 3, (shape[2:] * 256 + shape[1:-1] * 16 + shape[:-2]) * 104729 + 4]
    out = []
    for k, kind in enumerate(kinds):
        if len(kind):
            ids, n = np.unique((kind ^ (kind >> 21)) & (DIM // 4 - 1), return_counts=True)
            out.append((ids + k * (DIM // 4), n / np.sqrt((n * n).sum())))
    return np.concatenate([[0], *(x for x, _ in out)]), np.concatenate([[1.0], *(v for _, v in out)])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> np.ndarray:
    """Weights by FTRL-proximal (McMahan et al. 2013), from (ids, values, label) rows."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    weights = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in order.permutation(len(rows)):
            ids, values, y = rows[at]
            w = weights(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - y) * values
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    return weights(np.arange(DIM)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, n: int = 4, r: int = 2, most: int = TRAIN_DOCS) -> np.ndarray:
    rows = labelled(docs, labels, "quality", n, r, most, TRAIN_CHARS)

    def run(batches):
        memo, found = Tokens(), []
        for batch in batches:
            for d, t, y in zip(*batch.columns, strict=True):
                ids, values = features(t.as_py(), memo)
                found.append((d.as_py(), ids.astype(np.int32), values.astype(np.float32), y.as_py()))
        found.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))  # the same order however Spark deals the rows
        yield pa.RecordBatch.from_pydict({"weights": pa.array([train([x[1:] for x in found]).tobytes()], pa.binary())})

    got = rows.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32) if got else np.zeros(DIM, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Appends quality_score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    memos: dict[int, Tokens] = {}

    def run(texts: list) -> dict:
        w, memo = shared.value, memos.setdefault(0, Tokens())
        dots = [float(w[i] @ v) for i, v in (features(t, memo) for t in texts)]
        return {"quality_score": 1 / (1 + np.exp(-np.clip(np.array(dots, float), -35, 35)))}

    return map_texts(docs, run, "quality_score double")


def quality(docs: DataFrame, labels: DataFrame, n: int = 4, r: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more) of every document.

    Learns from labelled rows whose crc32 of doc_id modulo n is not r. Null and empty texts have the bias as their only
    feature. Rows with the same doc_id are scored each; a null doc_id is not held out and never labelled. Without labels
    every score is 0.5. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels, n, r))
    return out.select("doc_id", held_out(F.col("doc_id"), n, r).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
