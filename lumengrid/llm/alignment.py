"""Alignment of two tokenizers' tokens by pointer jumping, and how often their ids are linked in a corpus.

Every token points to the farthest-right token that overlaps it. Replacing each pointer by its pointer's pointer until
nothing changes, for all texts of a run at once, brings all tokens that hang together to one terminal token, which labels
their group. Links, all pairs of a group, are counted by id pair once for each document; each task sums the documents that
it has before rows are shuffled. A document's links meet the counts in two ways: those of the most frequent pairs, a table of
bounded size, in the task that holds the document, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .ranked_search import packed, unpacked
from .runs import text_runs

FOLDER = "/opt/tokenizers"
#: Bits of a B id in a pair's number.
B_BITS = 15
#: Links that are laid out at once; a document with more goes group by group.
LAID_OUT = 1 << 21
#: Frequent pairs that every task gets (12 bytes each).
HEAD = 1 << 20
#: Pairs that a task sums before it passes their counts on.
SUMMED = 1 << 22
#: A run of letters, digits or signs of this many characters takes an encoder whose time doesn't grow with its square.
LONG_PIECE = 2000
ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary, pair bigint, docs bigint"


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in turn from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of all ids, end to end."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.held = np.frombuffer(b"".join(parts), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.held[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Encoders:
    """Both tokenizers: ids of texts, and the bytes of their tokens."""

    def __init__(self, folder: str):
        import regex
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = f"{folder}/byte_bpe_50k.json"
        with open(path) as f:
            model = json.load(f)["model"]
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # ids are in the order of the merges, so merging by rank gives the file's tokens, faster
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.long_piece = regex.compile(rf"\p{{L}}{{{LONG_PIECE}}}|\p{{N}}{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}|[^\s\p{{L}}\p{{N}}]{{{LONG_PIECE}}}")
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        parts = [b""] * (max(ranks.values()) + 2)
        for token, i in ranks.items():
            parts[i] = token
        self.a_bytes = Vocabulary(parts)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = Vocabulary([piece(i) for i in range(self.b.get_piece_size())])
        self.names = [np.array([f"{i}{sep}" for i in range(n)], object) for n, sep in ((len(parts), ","), (len(parts), "|"), (self.b.get_piece_size(), ","), (self.b.get_piece_size(), ";"))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.slow.encode(" " + t, add_special_tokens=False).ids if len(t) >= LONG_PIECE and self.long_piece.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        return a, self.b.encode(texts, num_threads=1)


@cache
def encoders(folder: str) -> Encoders:
    return Encoders(folder)


# groups


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())), n


def same_bytes(vocabulary: Vocabulary, ids: np.ndarray, n: np.ndarray, held: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts the ids' bytes give again."""
    of = np.repeat(np.arange(len(n)), n)
    total = np.bincount(of, vocabulary.size[ids], len(n)).astype(np.int64)
    good = total == np.diff(starts)
    got, want = vocabulary.bytes_of(ids[good[of]]), held[np.repeat(good, np.diff(starts))]
    wrong = np.flatnonzero(got != want)
    if len(wrong):
        where = np.cumsum(np.where(good, total, 0))
        good[np.searchsorted(where, wrong, "right")] = False
    return good


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each A token, then each B token, the A token that ends its group; tokens are given by where they end."""
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)  # the token over each token's last byte
    to = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, np.arange(n)), over_b])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def distinct_links(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of one text with how many links each has, group by group: for texts with very many links."""
    pairs, counts, held = [], [], 0
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    for g in range(len(a_n)):
        ids, n = np.unique(a[a_at[g] : a_at[g] + a_n[g]], return_counts=True)
        ids_b, n_b = np.unique(b[b_at[g] : b_at[g] + b_n[g]], return_counts=True)
        step = max(1, LAID_OUT // len(ids_b))
        for i in range(0, len(ids), step):
            pairs.append(((ids[i : i + step, None] << B_BITS) | ids_b).ravel())
            counts.append((n[i : i + step, None] * n_b).ravel())
            held += len(pairs[-1])
            if held > 4 * LAID_OUT:
                pairs, counts = ([x] for x in summed(np.concatenate(pairs), np.concatenate(counts)))
                held = 0
    return summed(np.concatenate(pairs), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def links_of(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, text: np.ndarray, n_texts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """text, its distinct pairs in order, and their links; groups have a_n and b_n tokens and belong to text, in order."""
    links = a_n * b_n
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    of_text = np.bincount(text, links, n_texts).astype(np.int64)
    begins = np.searchsorted(text, np.arange(n_texts + 1))
    upto = np.cumsum(of_text)
    t = 0
    while t < n_texts:
        g, h = begins[t], begins[t + 1]
        if of_text[t] > LAID_OUT:
            pairs, counts = distinct_links(a[a_at[g] : a_at[h - 1] + a_n[h - 1]], b[b_at[g] : b_at[h - 1] + b_n[h - 1]], a_n[g:h], b_n[g:h])
            yield t, pairs, counts
            t += 1
            continue
        last = max(t + 1, int(np.searchsorted(upto, upto[t] - of_text[t] + LAID_OUT, "right")))
        h = begins[last]
        group = np.repeat(np.arange(g, h), links[g:h])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[g:h]) - links[g:h], links[g:h])
        keys = ((text[group] - t) << 32) | (a[a_at[group] + nth // b_n[group]] << B_BITS) | b[b_at[group] + nth % b_n[group]]
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n, owner, pairs = np.diff(np.append(first, len(keys))), keys[first] >> 32, keys[first] & 0xFFFFFFFF
        cut = np.searchsorted(owner, np.arange(last - t + 1))
        for i in range(last - t):
            yield t + i, pairs[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]
        t = last


class Run:
    """The aligned texts of a run of bytes."""

    def __init__(self, e: Encoders, held: np.ndarray, starts: np.ndarray):
        whole = held.tobytes()
        texts = [whole[x:y].decode() for x, y in zip(starts[:-1], starts[1:], strict=True)]
        lists = e.encode(texts)
        (a, a_n), (b, b_n) = (flat(x) for x in lists)
        spaced = np.insert(held, starts[:-1], 32)
        at = starts + np.arange(len(starts))
        good = same_bytes(e.a_bytes, a, a_n, spaced, at) & same_bytes(e.b_bytes, b, b_n, spaced, at) & (np.diff(starts) > 0)
        a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
        self.n_a, self.n_b = np.where(good, a_n, 0), np.where(good, b_n, 0)
        self.a, self.b, n = a, b, len(texts)
        to = terminals(np.cumsum(e.a_bytes.size[a]), np.cumsum(e.b_bytes.size[b])) if len(a) else np.zeros(0, np.int64)
        ends = np.flatnonzero(to[: len(a)] == np.arange(len(a)))
        group = np.searchsorted(ends, to)
        a_text, b_text = (np.repeat(np.arange(n), x) for x in (self.n_a, self.n_b))
        self.text = a_text[ends]
        self.n_groups = np.bincount(self.text, minlength=n)
        in_a, in_b = np.bincount(group[: len(a)], minlength=len(ends)), np.bincount(group[len(a) :], minlength=len(ends))
        self.n_links = np.bincount(self.text, in_a * in_b, n).astype(np.int64)
        self.links = links_of(a, b, in_a, in_b, self.text, n)
        # tokens in the order of groups, A's first, each with what follows it
        names = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[np.cumsum(in_a) - 1], last_b[np.cumsum(in_b) - 1] = True, True
        names[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group[: len(a)]]] = np.where(last_a, e.names[1][a], e.names[0][a])
        names[np.arange(len(b)) + np.cumsum(in_a)[group[len(a) :]]] = np.where(last_b, e.names[3][b], e.names[2][b])
        names = names.tolist()
        cut = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        self.sums = [hashlib.sha256("".join(names[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _aligned(folder: str):
    """A row for each text, and rows of pairs with how many of the task's texts have them linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoders(folder), TaskContext.get().partitionId() << 40
        schema = pa.schema([(x.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in ALIGNED.split(", ")])
        rows = lambda n, held: pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in schema], schema=schema)
        pairs, docs, waiting, total = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for first, end, held, starts in text_runs(batch.column(1)):
                one, blobs = Run(e, held, starts), []
                for _, ids, n in one.links:
                    blobs.append(packed(np.concatenate([np.diff(ids, prepend=0), n]))[0].tobytes())
                    waiting.append(ids)
                    total += len(ids)
                m = end - first
                counts = {"n_a": one.n_a, "n_b": one.n_b, "n_groups": one.n_groups, "n_links": one.n_links, "row": row + np.arange(m)}
                yield rows(m, {k: pa.array(v) for k, v in counts.items()} | {"doc_id": batch.column(0).slice(first, m), "groups_sha256": pa.array(one.sums), "links": pa.array(blobs, pa.binary())})
                row += m
                if total > SUMMED:
                    pairs, docs = summed(np.concatenate([pairs, *waiting]), np.concatenate([docs, *(np.ones(len(w), np.int64) for w in waiting)]))
                    waiting, total = [], 0
                    if len(pairs) > SUMMED:
                        yield rows(len(pairs), {"pair": pa.array(pairs), "docs": pa.array(docs)})
                        pairs, docs = pairs[:0], docs[:0]
        pairs, docs = summed(np.concatenate([pairs, *waiting]), np.concatenate([docs, *(np.ones(len(w), np.int64) for w in waiting)]))
        if len(pairs):
            yield rows(len(pairs), {"pair": pa.array(pairs), "docs": pa.array(docs)})

    return run


# counts of the corpus


def _met(head):
    """Sums of each text's links over frequent pairs; its other pairs as rows."""

    def run(batches):
        pairs, docs, best = head.value
        for batch in batches:
            rows, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            kept: list[tuple[np.ndarray, ...]] = []
            sums = np.zeros((2, len(rows)), np.int64)
            for i, blob in enumerate(blobs):
                v = unpacked(np.frombuffer(blob, np.uint8))
                ids, n = np.cumsum(v[: len(v) // 2]), v[len(v) // 2 :]
                at = np.minimum(np.searchsorted(pairs, ids), max(0, len(pairs) - 1))
                known = pairs[at] == ids if len(pairs) else np.zeros(len(ids), bool)
                sums[:, i] = (n[known] * best[at[known]]).sum(), (n[known] * docs[at[known]]).sum()
                kept.append((np.full(int((~known).sum()), rows[i]), ids[~known], n[~known]))
            row, ids, n = (np.concatenate([np.zeros(0, np.int64), *(k[j] for k in kept)]) for j in range(3))
            m = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rows, row])), pa.array(np.concatenate([np.zeros(len(rows), np.int64), ids]), mask=np.arange(len(rows) + m) < len(rows)), *(pa.array(np.concatenate([x, y])) for x, y in ((sums[0], n), (sums[1], np.zeros(m, np.int64))))], ["row", "pair", "best_or_links", "count_sum"])

    return run


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most most pairs in order, their documents and whether they are best: all pairs of over some number of documents."""
    sizes = counts.groupBy("docs").agg(F.count("*").alias("n")) if most else None
    # one row for each tenth of a power of two
    step = F.floor(F.log2("docs") * 10)
    steps = [] if sizes is None else sorted(((x.step, x.n) for x in sizes.groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for s, n in steps:
        held += n
        if held > most:
            break
        least = s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = counts.where(step >= least).select("pair", "docs", F.col("best").cast("bigint").alias("best")).toArrow()
    pairs, docs, best = (t[c].to_numpy() for c in ("pair", "docs", "best"))
    order = np.argsort(pairs)
    return pairs[order], docs[order], best[order]


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs (documents that have it linked) and best: whether no other pair of its A id is in more."""
    counts = keep(aligned.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    a = F.shiftright("pair", B_BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top"))  # as many rows as A has ids
    return keep(counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "link-counts")


def align(docs: DataFrame, folder: str = FOLDER, head: int = HEAD) -> DataFrame:
    """Groups and links of the tokens of each text (doc_id, text) under two tokenizers in folder.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each of docs, repeated
    doc_ids included; other columns are left out. Null and empty texts, and those whose tokens don't give their bytes again,
    have no tokens: zeros and an empty digest. They count for no pair. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    aligned = keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_aligned(folder), ALIGNED), "aligned")
    counts = link_counts(aligned)
    own = aligned.where("row IS NOT NULL")
    shared = spark.sparkContext.broadcast(frequent(counts, head))
    met = keep(own.select("row", "links").mapInArrow(_met(shared), "row bigint, pair bigint, best_or_links bigint, count_sum bigint"), "met")
    rare = met.where("pair IS NOT NULL").join(counts, "pair")
    n = F.col("best_or_links")
    some = met.where("pair IS NULL").select("row", n.alias("n_best"), "count_sum").unionByName(rare.select("row", F.when(F.col("best"), n).otherwise(0).alias("n_best"), (n * F.col("docs")).alias("count_sum")))
    sums = some.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return own.drop("links", "pair", "docs").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
