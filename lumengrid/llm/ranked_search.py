r"""Ranked lexical search over an inverted index in shards, by Block-Max MaxScore.

A shard is a run of whole texts of one task, so no text is shuffled. Of each term it has one row: its postings, in blocks of
documents' numbers and counts packed as variable-length bytes, and for each block its last document and the largest count and
shortest document in it, which bound what any of its postings adds to a score. For each item the lists of its terms are sorted
by their bounds. Lists that together can't reach the worst of the best k so far are not essential: only documents of
the others are candidates. Candidates then meet the remaining lists, the highest bound first; those whose score and bounds, the
block's instead of the list's, fall short go before a block is unpacked. Shards' best are merged by a window with a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, pieces, small, table
from .runs import piece_hashes, text_runs

NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text of a shard, and postings of a block.
SHARD, BLOCK = 1 << 23, 128
#: Documents that are scored before the best so far are looked at again.
STRIDE = 2048
#: Terms of items that one task holds for its shard, and terms (of at most about 100 bytes) that are broadcast.
MOST_TERMS, SMALL_TERMS = 1 << 16, 200_000
INDEX = "shard bigint, term string, df int, postings binary, blocks binary, ids array<bigint>, lengths array<bigint>"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# packing


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as bytes of 7 bits, the last of a value below 128; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(held: np.ndarray) -> np.ndarray:
    last = held < 128
    n = np.cumsum(last)
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(held) else np.zeros(0, np.int64)
    part = (held & 127).astype(np.int64) << (7 * (np.arange(len(held)) - first[n - last]))
    return np.add.reduceat(part, first) if len(first) else part


# the index


def tokens(held: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of each term of a run of lower-cased texts."""
    word = _WORD[held]
    edge = np.zeros(len(held) + 1, bool)
    edge[starts] = True
    begin = word & np.concatenate([[True], ~word[:-1]]) | word & edge[:-1]
    end = word & np.concatenate([~word[1:], [True]]) | word & edge[1:]
    a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return np.searchsorted(starts, a, "right") - 1, a, z


def _shard_rows(held: np.ndarray, starts: np.ndarray, block: int):
    """Lengths of the texts, then the rows of all terms: term, df, postings, blocks."""
    held = _LOWER[held]
    text, a, z = tokens(held, starts)
    lengths = np.bincount(text, minlength=len(starts) - 1)
    if not len(a):
        return lengths, None
    code = piece_hashes(held, a, z)
    order = np.argsort(code, kind="stable")  # by term, and by text within
    new_term = np.ones(len(order), bool)
    new_term[1:] = code[order][1:] != code[order][:-1]
    new = new_term.copy()
    new[1:] |= text[order][1:] != text[order][:-1]
    at = np.flatnonzero(new)
    tf, doc, first = np.diff(np.append(at, len(order))), text[order][at], new_term[at]
    begins = np.flatnonzero(first)
    df = np.diff(np.append(begins, len(at)))
    within = np.arange(len(at)) - np.repeat(begins, df)
    head = within % block == 0
    gap = np.where(head, doc, doc - np.concatenate([[0], doc[:-1]]))
    bytes_, size = packed(np.stack([gap, tf], 1).ravel())
    ends = np.cumsum(size[0::2] + size[1::2])
    h = np.flatnonzero(head)
    tail = np.append(h[1:], len(at)) - 1
    per_term = -(-df // block)
    list_start = np.concatenate([[0], ends])[begins]
    blocks = np.stack([doc[tail], np.maximum.reduceat(tf, h), np.minimum.reduceat(lengths[doc], h), ends[tail] - np.repeat(list_start, per_term)], 1).astype("<i4")
    pick = order[at[begins]]  # one place of each term
    n = z[pick] - a[pick]
    term_bytes = held[np.repeat(a[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    as_binary = lambda sizes, data, kind: pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return lengths, (as_binary(n, term_bytes, pa.string()), pa.array(df, pa.int32()), as_binary(np.diff(np.append(list_start, ends[-1])), bytes_, pa.binary()), as_binary(per_term * 16, blocks, pa.binary()))


def _indexed(shard: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lists = pa.list_(pa.int64())
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for row, end, held, starts in text_runs(batch.column(1), shard):
                lengths, rows = _shard_rows(held, starts, block)
                ids = batch.column(0).slice(row, end - row)
                n = len(ids)
                whole = lambda v: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.binary(), pa.binary())), whole(ids), whole(pa.array(lengths, pa.int64()))], names)
                if rows:
                    m = len(rows[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), *rows, pa.nulls(m, lists), pa.nulls(m, lists)], names)
                number += 1

    return run


def build_index(docs: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The index of docs (doc_id, text), written once: for each shard a row with its documents, and one for each term.

    A shard has at most shard bytes of text, or one longer text. Terms are told apart by 64 bits of a hash of their letters.
    """
    return keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_indexed(shard, block), INDEX), "index")


# the search


class Lists:
    """The lists of a shard: bounds of blocks, and blocks unpacked as they are needed."""

    def __init__(self, lengths: np.ndarray, n: int, total: int):
        self.m = 50 + (50 * lengths * n) // max(1, total)
        self.n, self.total, self.of, self.held = n, total, {}, {}
        self.unpacked = 0

    def add(self, term: int, postings: bytes, blocks: bytes) -> None:
        b = np.frombuffer(blocks, "<i4").reshape(-1, 4).astype(np.int64)
        bound = (1_000_000_000 * b[:, 1]) // (1000 * b[:, 1] + 20 * (50 + (50 * b[:, 2] * self.n) // max(1, self.total)))
        self.of[term] = (np.frombuffer(postings, np.uint8), b[:, 0], bound, np.concatenate([[0], b[:, 3]]), int(bound.max()))

    def blocks(self, term: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and what they add (for a weight of 1), of some blocks in order."""
        postings, _, _, ends, _ = self.of[term]
        docs, adds = [], []
        for k in which.tolist():
            if (term, k) not in self.held:
                v = unpacked(postings[ends[k] : ends[k + 1]])
                doc, tf = np.cumsum(v[0::2]), v[1::2]
                self.held[term, k] = doc, (1_000_000_000 * tf) // (1000 * tf + 20 * self.m[doc])
                self.unpacked += 1
            d, a = self.held[term, k]
            docs.append(d)
            adds.append(a)
        return (docs[0], adds[0]) if len(docs) == 1 else (np.concatenate(docs), np.concatenate(adds))


def best_of(lists: Lists, terms: list[tuple[int, int]], ids: np.ndarray, k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard (numbers, scores above 0) for terms with weights; ids break ties, the smaller first."""
    terms = sorted(((w * lists.of[t][4], w, t) for t, w in terms if t in lists.of and w > 0), reverse=True)
    rest = np.cumsum([0, *(b for b, _, _ in terms[::-1])])[::-1]  # what the lists from the i-th on can add
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(ids), stride):
        high = min(low + stride, len(ids))
        essential = int(np.searchsorted(-rest, -least, "right")) if least else len(terms)  # lists before it reach least
        dense = np.zeros(high - low, np.int64)
        for _, w, t in terms[:essential]:
            last = lists.of[t][1]
            which = np.arange(np.searchsorted(last, low), min(len(last), np.searchsorted(last, high - 1) + 1))
            if len(which):
                d, a = lists.blocks(t, which)
                i, j = np.searchsorted(d, (low, high))
                dense[d[i:j] - low] += w * a[i:j]
        found = np.flatnonzero(dense)
        score, found = dense[found], found + low
        for i in range(essential, len(terms)):
            _, w, t = terms[i]
            go = score + rest[i] >= least
            found, score = found[go], score[go]
            if not len(found):
                break
            _, last, bound, _, _ = lists.of[t]
            block = np.searchsorted(last, found)
            there = block < len(last)
            most = np.where(there, w * bound[np.minimum(block, len(last) - 1)], 0)
            go = score + most + rest[i + 1] >= least
            found, score, block, there = found[go], score[go], block[go], there[go]
            if there.any():
                d, a = lists.blocks(t, np.unique(block[there]))
                at = np.minimum(np.searchsorted(d, found), len(d) - 1)
                score = score + np.where(d[at] == found, w * a[at], 0)
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, score])
        if len(docs) > k:
            top = np.lexsort((ids[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
        if len(docs) == k:
            least = int(scores.min())
    return docs, scores


def _searched(n: int, total: int, k: int, stride: int):
    """Best documents of each item by shard. Rows in the order of shard and batch, the shard's documents before its terms."""

    def solved(ids, lengths, rows) -> pa.RecordBatch:
        lists, items = Lists(np.array(lengths, np.int64), n, total), {}
        for t, (_, postings, blocks, uses) in enumerate(rows):
            lists.add(t, postings, blocks)
            for u in uses:
                items.setdefault(u["item"], []).append((t, u["w"]))
        order = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64)
        ids = pa.array(ids, pa.int64())
        out = [(item, *best_of(lists, terms, order, k, stride)) for item, terms in items.items()]
        docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d, _ in out)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([i for i, _, _ in out], [len(d) for _, d, _ in out]), pa.int64()), ids.take(pa.array(docs)), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in out)]))], ["item", "doc_id", "score"])

    def run(batches):
        at, ids, lengths, rows = None, None, None, []
        for batch in batches:
            cols = [batch.column(i) for i in range(8)]
            for i in range(batch.num_rows):
                key = cols[0][i].as_py(), cols[1][i].as_py()
                if key != at:
                    if rows:
                        yield solved(ids, lengths, rows)
                    at, rows = key, []
                if cols[2][i].as_py() is None:
                    ids, lengths = cols[6][i].as_py(), cols[7][i].as_py()
                else:
                    rows.append(tuple(c[i].as_py() for c in cols[2:6]))
        if rows:
            yield solved(ids, lengths, rows)

    return run


def terms_of(text: Column) -> Column:
    return F.array_distinct(pieces(ascii_lower(text), NOT_TERM))


def search(index: DataFrame, items: DataFrame, k: int = 50, limit: int = SMALL_TERMS, most_terms: int = MOST_TERMS, stride: int = STRIDE) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text), by a score of whole numbers.

    Documents without a score above 0 don't count. Equal scores go by doc_id, null last. Every row of items is an item of
    its own and every row that was indexed a document, repeated ids included. Null and empty texts have no terms: such items
    find nothing. Tables of over limit terms are shuffled, not broadcast; items with together over most_terms terms are dealt
    to batches, each with its own task for each shard.
    """
    stats = index.where("term IS NULL").select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    n, total = stats.n, int(stats.total or 0)
    numbered = keep(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    of_items = keep(numbered.select("item", F.explode(terms_of(F.col("text"))).alias("term")), "item-terms")
    n_terms = of_items.count()
    vocabulary = of_items.select("term").distinct()
    lists = keep(index.where("term IS NOT NULL").select("shard", "term", "df", "postings", "blocks").join(small(vocabulary, n_terms, limit), "term"), "lists")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2.0) / (2.0 * F.sum("df") + 1.0))).cast("bigint")
    weights = lists.groupBy("term").agg(weight.alias("w")).where("w > 0")
    batches = max(1, -(-n_terms // most_terms))
    weighed = of_items.join(small(weights, n_terms, limit), "term").withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)))
    uses = keep(weighed.groupBy("batch", "term").agg(F.collect_list(F.struct("item", "w")).alias("uses")), "uses")
    rows = lists.join(small(uses, n_terms, limit), "term").select("shard", "batch", "term", "postings", "blocks", "uses", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("lengths"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint")))
    documents = index.where("term IS NULL").select("shard", every.alias("batch"), "term", "postings", "blocks", F.lit(None).cast("array<struct<item: bigint, w: bigint>>").alias("uses"), "ids", "lengths")
    together = rows.unionByName(documents).repartition("shard", "batch").sortWithinPartitions("shard", "batch", F.col("term").asc_nulls_first())
    found = together.mapInArrow(_searched(n, total, k, stride), "item bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(small(numbered.select("item", "item_id"), n_terms, limit), "item").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS nd, sum(len(w))::BIGINT AS total FROM t),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, st GROUP BY term, nd),
it AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
q AS (SELECT i, item_id, unnest(w) AS term FROM it),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * nd) // total AS m FROM t, st),
sc AS (SELECT i, item_id, r, doc_id, sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM rk WHERE rank <= 50
"""
