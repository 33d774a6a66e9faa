r"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased code points, with sublinear counts, inverse document frequency (counted
over all documents to learn from) and unit length. Weights come from follow-the-regularised-leader with L1 and L2
penalties, on a bounded sample of documents in one task, as many of each language as there is room for; a part of the
sample is set aside to fit the temperature that the probabilities are calibrated with.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_texts, sampled_within, table

#: Documents to learn from, at most about so many, shared out evenly among the languages, and code points of them all.
TRAIN_DOCS, TRAIN_CHARS = 6_000, 40_000_000
DIM = 1 << 15
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.05, 2
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a code point is a letter (Unicode category L); the pattern also finds other numerals."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers in order, and 1 + log of their counts."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = [c * np.uint32(2654435761)]
    if len(c) > 1:
        grams.append(c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917) + np.uint32(1))
    if len(c) > 2:
        grams.append(c[:-2] * np.uint32(668265263) + c[1:-1] * np.uint32(374761393) + c[2:] * np.uint32(2869860233) + np.uint32(2))
    n = np.bincount(np.concatenate(grams) >> np.uint32(17), minlength=DIM)
    ids = np.flatnonzero(n)
    return ids, 1 + np.log(n[ids])


def weighted(ids: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[ids]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, seed: int = 5) -> dict:
    """Languages, idf, weights (features by languages) and temperature, from rows of features, weights and language."""
    langs = sorted({y for *_, y in rows})
    found = [(ids, x, langs.index(y)) for ids, x, y in rows]
    z, n = np.zeros((DIM, len(langs))), np.zeros((DIM, len(langs)))
    weights = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    cut = len(found) - len(found) // 5 if len(found) >= 10 else len(found)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in order.permutation(cut):
            ids, x, y = found[at]
            w = weights(ids)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    w = weights(np.arange(DIM))
    logits = np.array([x @ w[ids] for ids, x, _ in found[cut:]] or np.zeros((0, len(langs))))
    y = np.array([y for *_, y in found[cut:]], int)
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(y)), y])).mean()
    temperature = min(np.geomspace(0.2, 5, 60), key=loss) if len(y) else 1.0
    return {"langs": langs, "idf": idf, "weights": w, "temperature": float(temperature)}


def fit(docs: DataFrame, n: int = 5, r: int = 0, most: int = TRAIN_DOCS) -> dict | None:
    wanted = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), n, r))

    def frequencies(batches):
        df = np.zeros(DIM, np.int64)
        for batch in batches:
            for text in batch.column(0):
                df[counts(text.as_py())[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])

    df = np.zeros(DIM)
    found = wanted.select("text").mapInArrow(frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # DIM rows at most
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + wanted.count()) / (1 + df)) + 1
    rows = sampled_within(wanted.select("doc_id", "text", "lang"), most, TRAIN_CHARS, "lang")

    def run(batches):
        got = []
        for batch in batches:
            for doc, text, lang in zip(*batch.columns, strict=True):
                ids, tf = counts(text.as_py())
                got.append((doc.as_py(), lang.as_py(), ids.astype(np.int32), weighted(ids, tf, idf).astype(np.float32)))
        got.sort(key=lambda x: (x[0], x[1], len(x[2]), x[3].tobytes()))  # the same order however Spark deals the rows
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train([(i, v, y) for _, y, i, v in got], idf))] if got else [], pa.binary())})

    got = rows.select("doc_id", "text", "lang").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def language(docs: DataFrame, n: int = 5, r: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score (calibrated probability of lang_pred) of every document.

    Learns from rows with a text and a lang whose crc32 of doc_id modulo n is not r. A null text, or one without a
    letter, is `und` with score 0; so is every text where there is nothing to learn from. Rows with the same doc_id are
    predicted each; a null doc_id is not held out and not learned from. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, n, r))

    def run(texts: list) -> dict:
        m = shared.value
        named, scores = [], []
        for text in texts:
            if m is None or text is None or not has_letter(text):
                named.append(UNKNOWN)
                scores.append(0.0)
                continue
            ids, tf = counts(text)
            p = softmax(weighted(ids, tf, m["idf"]) @ m["weights"][ids] / m["temperature"])
            named.append(m["langs"][int(p.argmax())])
            scores.append(float(p.max()))
        return {"lang_pred": named, "score": scores}

    out = map_texts(docs.select("doc_id", "text"), run, "lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), n, r).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))
