r"""SimHash near-duplicates found through a hierarchical index in Gray order.

The upper nodes of the index are pairs of a bit mask and a pattern that all fingerprints below share. The first level
has four masks of 16 bits: fingerprints that differ in at most three bits agree on one of them, so only such nodes need
to meet, and each node is a shuffle key. A node with too many members is split the same way over its free bits, as often
as needed. Inside a node fingerprints are sorted by Gray rank, runs of neighbours are folded into nodes of their shared
bits, and pairs of nodes are pruned where their shared patterns already differ in more bits than allowed. A node emits
no pairs, only its members' links to the smallest member that they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.operators.components import components

from .common import NO_ID, id_or_last, keep, table

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: Members of an upper node above which it is split, and of its free bits below which it cannot be.
NODE_ROWS, FEWEST_FREE = 8192, 12
FAN = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the text's shingle hashes have it."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    cuts = [b" ".join(t) for t in zip(*(w[i:] for i in range(shingle)))] if len(w) >= shingle else [b" ".join(w)]  # noqa: B905
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in cuts], "<u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        set_bits += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int) -> list[int]:
    """Four masks that each add a quarter of the free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _folded(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of the index over fingerprints in Gray order, from single ones up: (mask, pattern) of each node."""
    levels = [(np.full(len(fp), ~np.uint64(0)), fp)]
    while len(levels[-1][0]) > FAN:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FAN)
        both, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
        shared = np.bitwise_and.reduceat(mask, at) & ~(both ^ some)
        levels.append((shared, both & shared))
    return levels


def _close_pairs(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at most so many bits apart, in pieces of bounded size."""
    levels = _folded(fp)
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    work = [(len(levels) - 1, i, j)]
    while work:
        level, i, j = work.pop()
        if len(i) > 1 << 15:
            work += [(level, i[: 1 << 15], j[: 1 << 15]), (level, i[1 << 15 :], j[1 << 15 :])]
            continue
        mask, pattern = levels[level]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= most
        i, j = i[near], j[near]
        if level == 0:
            yield i[i < j], j[i < j]
        elif len(i):
            n = len(levels[level - 1][0])
            a, b = np.divmod(np.arange(FAN * FAN), FAN)
            i, j = (i[:, None] * FAN + a).ravel(), (j[:, None] * FAN + b).ravel()
            ok = (i <= j) & (j < n)
            work.append((level - 1, i[ok], j[ok]))


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the ends of each pair, and all that has their labels, the smallest label among them."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _links(most: int):
    """Links of a partition sorted by (mask, pattern, Gray rank): each member to the smallest that it reaches in its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(4))

        def linked(mask, pattern, fp, node):
            order = np.arange(len(fp))
            label = order.copy()
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            group = np.repeat(np.arange(len(starts)), sizes)
            bits = fp.view(np.uint64)
            for d in range(1, min(64, int(sizes.max(initial=1)))):  # small nodes all at once
                i = order[: len(fp) - d]
                i = i[(group[:-d] == group[d:]) & (sizes[group[:-d]] <= 64)]
                i = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= most]
                _join(label, i, i + d)
            for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
                for i, j in _close_pairs(bits[s : s + n], most):
                    _join(label, i + s, j + s)
            # the label is the first row in order; links go to the smallest node id
            least = np.full(len(fp), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            root = least[label]
            far = root != node
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["a", "b"])

        for batch in batches:
            own = tuple(np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest))
            changes = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))
            cut = changes[-1] + 1 if len(changes) else 0
            rest = tuple(x[cut:] for x in own)
            if cut:
                yield linked(*(x[:cut] for x in own))
        if len(rest[0]):
            yield linked(*rest)

    return run


def near_links(nodes: DataFrame, most: int = MOST_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints of nodes (fp, node) at most so many bits apart; most is at most 3."""
    spark = nodes.sparkSession
    masks = _split(0)
    rows = nodes.select("fp", "node", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    leaves: list[DataFrame] = []
    while True:
        free = 64 - masks[0].bit_count()
        large = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select("mask", "pattern") if free > FEWEST_FREE else None
        large = keep(large, "large-nodes") if large is not None else None
        if large is None or large.isEmpty():
            leaves.append(rows)
            break
        leaves.append(rows.join(large, ["mask", "pattern"], "left_anti").select(rows.columns))
        parts = spark.createDataFrame([(_signed(m), _signed(s)) for m in masks for s in _split(m)], "mask bigint, part bigint")
        deeper = rows.join(large, ["mask", "pattern"], "left_semi").join(F.broadcast(parts), "mask")
        rows = keep(deeper.select("fp", "node", F.col("part").alias("mask"), F.col("fp").bitwiseAND(F.col("part")).alias("pattern")), "split-nodes")
        masks = [s for m in masks for s in _split(m)]
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    routed = every.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
    return routed.select("mask", "pattern", "fp", "node").mapInArrow(_links(most), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over fingerprints at most so many bits apart.

    Fingerprints are the nodes of the graph, so copies add no links. Null, empty and blank texts have fingerprint zero and
    link like any other. Rows with the same doc_id keep a row each, and are linked only by their texts. A null doc_id
    counts as larger than any other; a component of such rows alone has a null component_id. An empty table gives an
    empty result.
    """
    prints = keep(fingerprints(docs, shingle), "fingerprints")
    nodes = keep(prints.groupBy("fp").agg(F.min(id_or_last(F.col("doc_id"))).alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp", F.col("fp").alias("node")), most))
    rooted = keep(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = keep(rooted.groupBy("root").agg(F.min("least").alias("id")), "ids")
    named = keep(rooted.join(ids, "root").select("fp", F.when(F.col("id") != F.lit(NO_ID), F.col("id")).alias("component_id")), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
