"""One of each group of near copies: documents that share at least 0.8 of their five-word pieces.

Candidates come from SimHash over the set of pieces, 128 bits wide. Those that differ in at most three of the first 64 bits
come from the hierarchical index in Gray order (simhash.py). Pieces that are shared to 0.8 leave about 20 of those
bits different, too many for blocks that must agree; so each of 64 masks takes 16 of the bits, and documents that agree on
any of them meet in a bucket. With more documents masks take more bits, and there are more masks, so that buckets stay small
and as many pairs meet. There documents stand in Gray order and those at most 40 bits apart are candidates. Each pair is
confirmed on the texts. Of simulated pairs that share just 0.8, 94 % meet; of those that share 0.85, 98.6 %; 0.9, 99.8 %.

A large group of near copies has too many pairs to confirm all. So a row is first linked to the nearest few before it in each
bucket. Buckets where that left any candidate out are gone through once more, in blocks of bounded size, all rows against all:
what is left there of pairs whose rows no confirmed links join yet is confirmed too. Most of
those candidates aren't near copies. Counts of a text's pieces by BINS bins of their hash tell so for sure: the counts of two
texts differ by no more than the pieces that just one of them has, so where they differ by more than near copies may, the pair
needs no look at the texts. (They tell much of texts of some hundred words, little of those of some thousand.)

Last comes an exact pass for what fingerprints don't tell: near copies that no mask brings together. In an order of all pieces,
two sets that share LEAST_SHARED have one in common among the first of each, as many as may be missing and one more: their
marks. So rows meet by marks, again only where no confirmed links join them yet, and all pairs that their counts and the
number of marks in common don't rule out are confirmed. Pieces stand in the order of their hash, but those of many texts come
last: then a passage of many texts is a mark only where little else is. Which pieces these are is told from a sample, as
it changes the work, not the groups.

Texts are by far the widest column. They are read where they stand, in the table of rows, by a map of the rows that are
wanted, a bit for each; only those of pairs to confirm are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.operators.components import components

from .common import id_or_last, keep, map_texts, small
from .simhash import SEED, gray_rank, near_links

WORDS, LEAST_SHARED = 5, 0.8
BITS, FAR_BITS = 128, 40
#: Bits of a mask and masks, for up to so many documents; beyond, a bit more for each doubling and as many more masks as keep the share of pairs that meet.
MASK_BITS, N_MASKS, FOR_ROWS, AGREE = 16, 64, 1 << 24, 1 - 20 / 128
#: Links of a row to rows before it in a bucket, the nearest; in a bucket of more than ALL_PAIRS rows, among the last WINDOW.
NEAREST, ALL_PAIRS, WINDOW = 4, 1024, 256
#: Rows of a block of a bucket that is gone through again, and pairs that are passed on at once.
BLOCK, PASSED_ON = 2048, 1 << 18
#: Bins of the counts of pieces; a count stops at 255, which can only make a difference smaller.
BINS = 128
#: Texts that a piece is in above which it comes last in the order, and how many such pieces there are at most.
OFTEN, MOST_OFTEN = 256, 1 << 16
#: They are told from one text in so many, but from so many texts at least.
ONE_IN, LEAST_TEXTS = 16, 8192
#: Marks in common, full buckets, roots and numbers of the map of wanted rows that are sent to all tasks, at most.
SMALL_ROWS = 1 << 20
#: Rows of groups that are gone through at once.
AT_ONCE = 4096
NONE = np.empty(0, np.uint64)


def masks(n: int) -> np.ndarray:
    """Bit places of each mask for n documents: whole dealings of all bits."""
    bits = min(48, MASK_BITS + max(0, int(np.ceil(np.log2(max(1, n) / FOR_ROWS)))))
    wanted, each = int(np.ceil(N_MASKS / AGREE ** (bits - MASK_BITS))), BITS // bits
    deals = np.random.default_rng(SEED).permuted(np.tile(np.arange(BITS), (-(-wanted // each), 1)), axis=1)
    return deals[:, : each * bits].reshape(-1, bits)


def shingles(text: str | None) -> set[bytes]:
    """The five-word pieces of a text, or all of a shorter one; blank texts have none."""
    w = (text or "").encode("utf-8").lower().split()
    if len(w) < WORDS:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}


def shared(a: set, b: set) -> float:
    """The share of the pieces of both that each has; two blank texts share all."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def digests_of(text: str | None) -> bytes:
    """The digests of a text's pieces, sorted."""
    return b"".join(sorted({xxhash.xxh128_digest(s, SEED) for s in shingles(text)}))


def marks(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of a set's hashes, sorted, the first in an order that has those of often (sorted) last: any set that shares LEAST_SHARED with it has one of them."""
    if len(often):
        last = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: len(hashes) - int(unmarked(len(hashes)))]


def unmarked(size: np.ndarray | int) -> np.ndarray:
    """How many pieces of sets of these sizes are no marks."""
    return np.maximum(np.ceil(LEAST_SHARED * np.asarray(size) - 1e-6).astype(np.int64) - 1, 0)


def least_marks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks that near copies of these sizes have in common at least: where the marks of one end, only its other pieces can still be shared."""
    return np.ceil((x + y) * (LEAST_SHARED / (1 + LEAST_SHARED)) - 1e-6).astype(np.int64) - np.maximum(unmarked(x), unmarked(y))


def piece_hashes(digests: bytes) -> np.ndarray:
    """64 bits of each digest, in their order."""
    return np.frombuffer(digests, ">u8")[::2].astype(np.uint64)


def sketch(texts: list, often: np.ndarray = NONE) -> dict:
    """node, a hash of the set of pieces, its fingerprint's halves, its size, its counts by bins and its marks, with those of often last."""
    node, halves, sizes, counts, first = [], np.zeros((len(texts), 2), "<u8"), np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        digests = digests_of(text)
        node.append(xxhash.xxh64_intdigest(digests, SEED))
        hashes = np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8)
        set_bits = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 4096):
            set_bits += np.unpackbits(hashes[k : k + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        halves[i] = np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")
        sizes[i] = len(hashes)
        counts.append(np.minimum(np.bincount(hashes[:, 0] % BINS, minlength=BINS), 255).astype(np.uint8).tobytes())
        first.append(marks(piece_hashes(digests), often).tobytes())
    return {"node": np.array(node, np.uint64).view(np.int64), "high": halves[:, 0].copy().view(np.int64), "low": halves[:, 1].copy().view(np.int64), "size": sizes, "counts": counts, "marks": first}


def may_share(size: np.ndarray, counts: np.ndarray, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where sets j may share LEAST_SHARED with set i: of both, d pieces are in just one, and d is at least what the counts differ by.

    The union has half of (sizes of both + d) pieces, of which d may be 1 - LEAST_SHARED at the most.
    """
    d = np.abs(counts[j].astype(np.int16) - counts[i]).sum(axis=1, dtype=np.int64)
    return d * (1 + LEAST_SHARED) <= (size[j] + size[i]) * (1 - LEAST_SHARED) + 1e-6


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the pieces of each text."""
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(piece_hashes(digests_of(text.as_py())).view(np.int64))], ["piece"])


def often_met(docs: DataFrame, often: int) -> np.ndarray:
    """Pieces of more than about so many differing texts, the most frequent ones, sorted; told from one text in ONE_IN, by a hash of the text."""
    share = max(1 / ONE_IN, min(1.0, LEAST_TEXTS / max(1, docs.count())))
    chosen = F.pmod(F.xxhash64(F.lit("often"), "text"), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select("text").where(F.col("text").isNotNull() & chosen).distinct()
    met = texts.mapInArrow(_pieces, "piece bigint").groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") > often * share)
    return np.sort(met.orderBy(F.desc("n"), "piece").limit(MOST_OFTEN).toArrow()["piece"].to_numpy().view(np.uint64))


def wanted_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose _row is in wanted (_row). These are sent to all tasks as a number for each 64 rows, so that rows aren't shuffled."""
    numbers = keep(wanted.groupBy(F.shiftright("_row", 6).alias("_of")).agg(F.expr("bit_or(shiftleft(1L, CAST(_row & 63 AS INT)))").alias("_bits")), "wanted")
    found = rows.withColumn("_of", F.shiftright("_row", 6)).join(small(numbers, numbers.count(), SMALL_ROWS), "_of")
    return found.where("getbit(_bits, CAST(_row & 63 AS INT)) = 1").select(rows.columns)


def _bucketed(places_of: np.ndarray):
    """Each node (node, high, low) in a bucket for every mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, high, low = (batch.column(k).to_numpy() for k in range(3))
            bits = np.unpackbits(np.stack([high, low], axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
            for m, places in enumerate(places_of):
                bucket = (bits[:, places].astype(np.int64) << np.arange(len(places))).sum(axis=1) | m << 48
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node), pa.array(high), pa.array(low)], ["bucket", "node", "high", "low"])

    return run


def _near(bucket: np.ndarray, node: np.ndarray, high: np.ndarray, low: np.ndarray, nearest: int, all_pairs: int) -> pa.RecordBatch:
    """Pairs (a, b) of whole buckets: each row and the nearest before it. Buckets where others were left out come as full."""
    n = len(node)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    last, small = np.repeat(starts + sizes, sizes), np.repeat(sizes <= all_pairs, sizes)
    apart, other, seen = np.full((n, nearest), FAR_BITS + 1, np.int16), np.full((n, nearest), -1), np.zeros(n, np.int64)
    i, d = np.arange(n), 0
    while True:
        d += 1
        i = i[(i + d < last[i]) & (small[i] | (d <= WINDOW))]
        if not len(i):
            break
        j = i + d
        bits = np.bitwise_count(high[i] ^ high[j]).astype(np.int16) + np.bitwise_count(low[i] ^ low[j])
        close = np.flatnonzero(bits <= FAR_BITS)
        a, j, bits = i[close], j[close], bits[close]
        seen[j] += 1
        worst = apart[j].argmax(axis=1)
        better = bits < apart[j, worst]
        apart[j[better], worst[better]], other[j[better], worst[better]] = bits[better], a[better]
    j, k = np.nonzero(other >= 0)
    a, b = node[other[j, k]], node[j]
    full = np.unique(bucket[(seen > nearest) | ~small])
    none = lambda m: np.zeros(m, np.int64)
    is_full = np.arange(len(a) + len(full)) >= len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.r_[np.minimum(a, b), none(len(full))], mask=is_full), pa.array(np.r_[np.maximum(a, b), none(len(full))], mask=is_full), pa.array(np.r_[none(len(a)), full], mask=~is_full)], ["a", "b", "full"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (bucket, one, two, block, node, high, low, root, size, counts; sorted by the first three), with the marks that they must share.

    They are near by their fingerprints, not ruled out by their counts and of different roots.
    """

    def solved(groups: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(g[0]) for g in groups]
        one, two, block, node, high, low, root, size, counts = (np.concatenate(x) for x in zip(*groups, strict=True))
        high, low, found, total = high.view(np.uint64), low.view(np.uint64), [], 0
        counts = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, BINS)
        pairs = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["a", "b", "least"])
        end, i, d = np.repeat(np.cumsum(sizes), sizes), np.arange(len(node)), 0
        while True:
            d += 1
            i = i[i + d < end[i]]
            if not len(i):
                break
            a = i[(root[i + d] != root[i]) & ((one[i] == two[i]) | (block[i + d] != block[i]))]
            a = a[np.abs(size[a + d] - size[a]) * (1 + LEAST_SHARED) <= (size[a + d] + size[a]) * (1 - LEAST_SHARED) + 1e-6]
            a = a[np.bitwise_count(high[a + d] ^ high[a]).astype(np.int16) + np.bitwise_count(low[a + d] ^ low[a]) <= FAR_BITS]
            a = a[may_share(size, counts, a, a + d)]
            found.append((np.minimum(node[a], node[a + d]), np.maximum(node[a], node[a + d]), least_marks(size[a], size[a + d])))
            total += len(a)
            if total > PASSED_ON:
                yield pairs()
                found, total = [], 0
        if total:
            yield pairs()

    now, groups, n = None, [], 0
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=k < 9) for k in range(10)]
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for c in cols[:3]:
            changed[1:] |= c[1:] != c[:-1]
        cuts = np.r_[0, np.flatnonzero(changed), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[a]) for c in cols[:3])
            if key != now:
                if held:
                    groups.append([np.concatenate(x) for x in zip(*held, strict=True)])
                    n += len(groups[-1][0])
                if n >= AT_ONCE:
                    yield from solved(groups)
                    groups, n = [], 0
                now, held = key, []
            held.append([c[a:z] for c in cols[1:]])
    if held:
        groups.append([np.concatenate(x) for x in zip(*held, strict=True)])
        yield from solved(groups)


def left_out(buckets: DataFrame, full: DataFrame, roots: DataFrame, block: int, counts: DataFrame) -> DataFrame:
    """Near pairs of full buckets whose rows have different roots. Every two blocks of a bucket meet in a group of their own.

    counts (node, size, counts) tells for sure which of them can't be near copies.
    """
    again = buckets.join(full, "bucket", "left_semi").join(small(roots, roots.count(), SMALL_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = again.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.countDistinct("root").alias("roots")).where("roots > 1")
    own = again.join(sizes.select("bucket", "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "k").alias("one"), F.greatest("block", "k").alias("two"), "block", "node", "high", "low", "root")
    return dealt.join(counts, "node").select(*dealt.columns, "size", "counts").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two").mapInArrow(_apart, "a bigint, b bigint, least bigint")


def _by_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each mark of rows (node, root, marks)."""
    for batch in batches:
        if batch.num_rows:
            sizes = np.array([len(m) // 8 for m in batch.column(2).to_pylist()])
            found = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in range(2))], ["bucket", "node", "root"])


def unmet(rows: DataFrame, nodes: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Pairs of nodes of different roots that have enough marks in common and are not ruled out by their counts: all that may be near copies.

    rows: _row, node, marks. nodes: node, size, counts, first (with the row that stands for the node).
    """
    # rows with the same pieces are one node
    own = wanted_of(rows.select("_row", "node", "marks"), nodes.select(F.col("first.row").alias("_row"))).join(small(roots, roots.count(), SMALL_ROWS), "node", "left")
    by_mark = own.select("node", F.coalesce("root", "node").alias("root"), "marks").mapInArrow(_by_mark, "bucket bigint, node bigint, root bigint")
    met = by_mark.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = keep(met.select("bucket"), "marks")
    # without fingerprints, which must not rule out anything here
    buckets = by_mark.select("bucket", "node", F.lit(0).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("low"))
    pairs = left_out(buckets, small(met, met.count(), SMALL_ROWS), roots, block, nodes.select("node", "size", "counts"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")


def _pairs(nearest: int, all_pairs: int):
    """Pairs of a partition sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _paired(batches, nearest, all_pairs)

    return run


def _paired(batches: Iterator[pa.RecordBatch], nearest: int, all_pairs: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    for batch in batches:
        own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy().view(np.uint64)]
        cut = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
        if held and len(own[0]) and held[-1][0][-1] != own[0][-1]:
            yield _near(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in own], strict=True)), nearest, all_pairs)
            held = []
        elif cut:
            yield _near(*(c[:cut] for c in own), nearest, all_pairs)
        if len(own[0]):
            held.append([c[cut:] for c in own])
    if held:
        yield _near(*(np.concatenate(x) for x in zip(*held, strict=True)), nearest, all_pairs)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, text of a, text of b) that are near copies."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        near = pa.array([shared(shingles(x[k].as_py()), shingles(y[k].as_py())) >= LEAST_SHARED for k in range(batch.num_rows)], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, size and counts of a, size and counts of b) that their counts don't rule out."""
    for batch in batches:
        if batch.num_rows:
            size = np.concatenate([batch.column(k).to_numpy() for k in (2, 4)])
            counts = np.frombuffer(b"".join(batch.column(3).to_pylist() + batch.column(5).to_pylist()), np.uint8).reshape(-1, BINS)
            i = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(may_share(size, counts, i, i + batch.num_rows)))


def one_of_each(docs: DataFrame, nearest: int = NEAREST, all_pairs: int = ALL_PAIRS, block: int = BLOCK, often: int = OFTEN) -> DataFrame:
    """docs without all but one row of each group of near copies, the one with the smallest doc_id.

    A group is what confirmed pairs connect. Rows are told apart as rows: of several with one doc_id, or with none, each
    stays or goes by its text. A null doc_id counts as larger than any other. Null, empty and blank texts are one group.
    Other columns are kept as they are, whatever their names.
    nearest, all_pairs, block and often are about work only: the groups don't depend on them.
    """
    own = [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]  # no clash with the columns made here
    docs_of = docs.toDF(*own)
    last = often_met(docs_of, often)
    rows = keep(map_texts(docs_of.withColumn("_row", F.monotonically_increasing_id()), lambda texts: sketch(texts, last), "node bigint, high bigint, low bigint, size bigint, counts binary, marks binary"), "sketched")
    first = F.min(F.struct(id_or_last(F.col("doc_id")).alias("id"), F.col("_row").alias("row"))).alias("first")
    nodes = keep(rows.groupBy("node", "high", "low", "size", "counts").agg(first), "nodes")
    buckets = nodes.select("node", "high", "low").mapInArrow(_bucketed(masks(nodes.count())), "bucket bigint, node bigint, high bigint, low bigint")
    sorted_rows = buckets.repartition("bucket").sortWithinPartitions("bucket", gray_rank(F.col("high")), "low")
    found = keep(sorted_rows.mapInArrow(_pairs(nearest, all_pairs), "a bigint, b bigint, full bigint").distinct(), "pairs")
    indexed = near_links(nodes.select(F.col("high").alias("fp"), "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    full = found.where("full IS NOT NULL").select(F.col("full").alias("bucket"))
    sketched = lambda k: nodes.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("counts").alias(f"counts_{k}"))
    near = found.where("full IS NULL").select("a", "b").unionByName(indexed).distinct().join(sketched("a"), "a").join(sketched("b"), "b")
    pairs = keep(near.select("a", "b", "size_a", "counts_a", "size_b", "counts_b").mapInArrow(_possible, "a bigint, b bigint"), "candidates")

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select(F.col("first.row").alias("_row"))
        texts = keep(wanted_of(rows.select("_row", "node", "text"), wanted).select("node", "text"), "texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return keep(both.select("a", "b", "x", "y").mapInArrow(_confirmed, "a bigint, b bigint"), "confirmed")

    links = confirmed(pairs)
    roots = components(links)

    def completed(more: DataFrame, links: DataFrame, roots: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Links and roots with those of more candidates."""
        more = keep(more.distinct().join(pairs, ["a", "b"], "left_anti"), name)
        if more.isEmpty():
            return links, roots
        found = confirmed(more)
        return (links.unionByName(found), components(links.unionByName(found))) if not found.isEmpty() else (links, roots)

    if n_full := full.count():
        links, roots = completed(left_out(buckets, small(full, n_full, SMALL_ROWS), roots, block, nodes.select("node", "size", "counts")).select("a", "b"), links, roots, "more-pairs")
    _, roots = completed(unmet(rows, nodes, roots, block), links, roots, "unmet-pairs")
    stay = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return wanted_of(rows, stay.select(F.col("first.row").alias("_row"))).select(own).toDF(*docs.columns)
