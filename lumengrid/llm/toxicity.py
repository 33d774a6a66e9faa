r"""Toxic passages as maximum-scoring segments of token log-odds.

Words and their beginnings are counted by label on a bounded sample of labelled documents. A word's probability of a
toxic document is a chain of Dirichlet (two classes: beta) posteriors: each beginning has the shorter one's estimate as
its prior. Log-odds against the average document, less a drift, are the scores of a text's words. One linear scan finds
all maximal segments (Ruzzo and Tompa 1999); their scores are measured against the extreme-value distribution of the
best segment in clean documents (Karlin and Altschul 1990), and the evidence of the significant ones is calibrated.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, map_texts, sha256, table

#: Labelled documents to learn from, at most about so many, and code points of them all.
TRAIN_DOCS, TRAIN_CHARS = 12_000, 60_000_000
#: Lengths of word beginnings, none left out; the whole word is the last link of the chain.
PREFIXES = (3, 4, 5, 6, 7, 8)
PRIOR = 4.0  # documents that the shorter beginning's estimate counts as
LEAST_DOCS, LEAST_Z = 4, 2.5  # evidence for a toxic entry
DRIFT = 1.0
SIGNIFICANT = 0.05
#: Entries of the table of toxic words, by evidence; they are sent to every task.
MOST_ENTRIES = 50_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def links(word: str, prefixes: tuple[int, ...] = PREFIXES) -> list[str]:
    """The word's beginnings and, last, the word itself as `word$`."""
    return [word[:n] for n in prefixes if len(word) >= n] + [word + "$"]


class WordScores(dict):
    """Log-odds less drift of a word, from the longest link with evidence; words without any get minus drift."""

    def __init__(self, entries: dict[str, float], drift: float, prefixes: tuple[int, ...] = PREFIXES):
        self.entries, self.drift, self.prefixes = entries, drift, prefixes

    def __missing__(self, word: str) -> float:
        found = [self.entries[x] for x in links(word, self.prefixes) if x in self.entries]
        score = (found[-1] if found else 0.0) - self.drift
        if len(self) < 500_000:
            self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - q) for s, e, q, r in stack]


def evidence(scores: np.ndarray, lam: float, k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -log p over the significant segments of a text, and those segments (start word, end word, p)."""
    found, n = [], max(1, len(scores))
    for s, e, score in maximal_segments(scores):
        p = -math.expm1(-k * n * math.exp(-min(700.0, lam * score)))
        if p < SIGNIFICANT:
            found.append((s, e, max(p, 1e-300)))
    return -sum(math.log(p) for _, _, p in found), found


def decay(values: np.ndarray) -> float:
    """The positive root of mean(exp(x * values)) = 1; values have a negative mean. One more value of 1 bounds it."""
    values = np.append(values, 1.0)
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(np.minimum(700, mid * values)).mean() < 1 else (low, mid)
    return (low + high) / 2


def platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature, by Newton's method with a slight ridge."""
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return a, b


def entries_of(rows: DataFrame, prefixes: tuple[int, ...]) -> dict[str, float]:
    """Log-odds of the links with evidence, from rows (text, label). Of equal texts one counts."""

    def counted(batches):
        for batch in batches:
            tokens, classes = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {x for w in set(words(text)) for x in links(w, prefixes)} | {""}
                tokens += own
                classes += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(classes, pa.int32())], ["token", "label"])

    one = rows.groupBy(sha256(F.col("text")), "label").agg(F.min("text").alias("text"))
    counts = one.select("text", "label").mapInArrow(counted, "token string, label int").groupBy("token").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("u"))
    total = counts.where("token = ''").first()
    t0, u0 = (total.t, total.u) if total else (0, 0)
    base = math.log((t0 + 0.5) / (u0 + 0.5))
    odds = F.log((F.col("t") + 0.5) / (F.col("u") + 0.5)) - base
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("u") + 0.5))
    listed = counts.where((F.col("t") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "token").limit(MOST_ENTRIES).collect()
    seen = {x.token: (x.t, x.u) for x in listed if x.token}
    entries = {}
    for token in seen:
        q = 1 / (1 + math.exp(-base))
        for link in links(token[:-1], prefixes) if token.endswith("$") else [token[:n] for n in prefixes if n <= len(token)]:
            if link in seen:
                t, u = seen[link]
                q = (t + PRIOR * q) / (t + u + PRIOR)
        entries[token] = math.log(q / (1 - q)) - base
    return entries


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", n: int = 5, r: int = 0, most: int = TRAIN_DOCS, prefixes: tuple[int, ...] = PREFIXES) -> dict:
    """The model: entries (link to log-odds), prefixes, lam, k, slope, intercept.

    A third of the documents, by a hash of the id, calibrates what the others taught; then the entries are learned from all.
    """
    rows = labelled(docs, labels, label, n, r, most, TRAIN_CHARS).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    memo = WordScores(entries_of(rows.where("NOT half"), prefixes), DRIFT, prefixes)
    kept: list[tuple[int, np.ndarray]] = []
    for x in rows.where("half").select("text", "label").mapInArrow(_squeezed(memo), "label int, n int, at array<int>, s array<double>").toLocalIterator():
        s = np.full(x.n, -DRIFT)
        s[np.array(x["at"], int)] = x.s
        kept.append((x.label, s))
    kept.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))  # the same sums however Spark deals the rows
    clean = [s for y, s in kept if y == 0 and len(s)]
    lam = decay(np.concatenate(clean)) if clean else 1.0
    best = [(len(s), max((x[2] for x in maximal_segments(s)), default=0.0)) for s in clean]
    k = (len(best) + 1) / (1 + sum(n * math.exp(-lam * s) for n, s in best))
    x = np.array([math.log1p(evidence(s, lam, k)[0]) for _, s in kept])
    slope, intercept = platt(x, np.array([y for y, _ in kept], float)) if kept else (1.0, -2.0)
    return {"entries": entries_of(rows, prefixes), "prefixes": prefixes, "lam": lam, "k": k, "slope": slope, "intercept": intercept}


def _squeezed(memo: WordScores):
    """Word scores of each text, without those that are just minus drift."""

    def run(batches):
        for batch in batches:
            n, at, kept = [], [], []
            for text in batch.column(0).to_pylist():
                s = np.array([memo[w] for w in words(text)])
                where = np.flatnonzero(s != -memo.drift)
                n.append(len(s))
                at.append(where)
                kept.append(s[where])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.float64()))], ["label", "n", "at", "s"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Appends toxic_score (0 to 1) and toxic_spans (start word, end word and p of each significant passage, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[int, WordScores] = {}

    def run(texts: list) -> dict:
        m = shared.value
        word_scores = memo.setdefault(0, WordScores(m["entries"], DRIFT, m["prefixes"]))
        scores, spans = [], []
        for text in texts:
            total, found = evidence(np.array([word_scores[w] for w in words(text)], float), m["lam"], m["k"])
            scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, m["slope"] * math.log1p(total) + m["intercept"])))))
            spans.append(",".join(f"{s}:{e}:{p:.3g}" for s, e, p in found))
        return {"toxic_score": scores, "toxic_spans": spans}

    return map_texts(docs, run, "toxic_score double, toxic_spans string")


def toxicity(docs: DataFrame, labels: DataFrame, n: int = 5, r: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the spans of its toxic passages in words.

    Learns from labelled rows whose crc32 of doc_id modulo n is not r. Null and empty texts have no passage and get the
    score of such a text. Rows with the same doc_id are scored each; a null doc_id is not held out and never labelled.
    Without labels every score is low. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, labels, "toxic", n, r))
    return out.select("doc_id", held_out(F.col("doc_id"), n, r).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
