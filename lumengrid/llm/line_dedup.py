"""Line deduplication with two Bloom filters.

Each partition folds its line hashes into a pair of filters: hashes seen once and hashes seen twice. Two pairs merge
without looking at lines again: a bit set in both once-filters, or in either twice-filter, belongs to the merged
twice-filter, which so holds every hash that occurs in two places. Only lines that this filter suspects are shuffled;
grouping them by their exact key confirms the repeats and picks the first document. The filter has a fixed largest
size. A corpus that outgrows it deals its line hashes out by range, so that each task has a filter of its own
hashes; what comes twice goes back to the documents by a join, and the rest is the same.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_last, keep, sha256, table

BLANK = b" \t\n\x0b\x0c\r"
PROBES = 5
BITS_PER_LINE = 12
LEAST_BITS, MOST_BITS = 17, 29  # powers of two: 16 KB to 64 MB
SHARD_BYTES = 1 << 14


def keys_of(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each line's key, or None where it is too short to count."""
    lines = (text or "").encode("utf-8").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(BLANK).lower()
        n = len(key)
        keys.append(key if n >= 4 * min_chars or n >= min_chars and len(key.decode("utf-8")) >= min_chars else None)
    return lines, keys


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit positions of each 64-bit hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)


def holds(packed: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((packed[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(packed: np.ndarray, pos: np.ndarray) -> None:
    np.bitwise_or.at(packed, (pos >> np.uint64(3)).ravel(), (np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8)).ravel())


def _partition_filters(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found += [xxhash.xxh64_intdigest(k) for k in {k for k in keys_of(text, min_chars)[1] if k is not None}]
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            pos = positions(hashes, bits)
            again = (n > 1) | holds(once, pos)
            put(twice, pos[again])
            put(once, pos[~again | (n > 1)])
        size = min(SHARD_BYTES, once.size)
        for shard in range(once.size // size):
            a = once[shard * size : (shard + 1) * size]
            if a.any():
                b = twice[shard * size : (shard + 1) * size]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "once": [zlib.compress(a, 1)], "twice": [zlib.compress(b, 1)]})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the partial filters of each shard, which come sorted by shard."""
    shard, once, twice = None, None, None
    as_row = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "twice": [zlib.compress(twice, 1)]})
    for batch in batches:
        for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "once", "twice")), strict=True):
            a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
            if s != shard:
                if shard is not None:
                    yield as_row()
                shard, once, twice = s, a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    if shard is not None:
        yield as_row()


def filter_bits(docs: DataFrame) -> int:
    """Bits, as a power of two, of a filter for all lines of docs."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return max(LEAST_BITS, math.ceil(math.log2(BITS_PER_LINE * lines)))


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """Packed bytes of the filter of 2**bits bits that holds every line hash found in two documents."""
    parts = docs.select("text").mapInArrow(_partition_filters(bits, min_chars), "shard int, once binary, twice binary")
    merged = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merged, "shard int, twice binary")
    packed = np.zeros(1 << bits - 3, np.uint8)
    size = min(SHARD_BYTES, packed.size)
    for row in merged.toLocalIterator():
        packed[row.shard * size : (row.shard + 1) * size] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return packed


def suspected_hashes(named: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """_id, _part and hash of the lines that filters of single ranges of hashes suspect, for any number of lines.

    Hashes of the distinct lines of each document (8 bytes, not texts) are dealt out by range. Each range, small
    enough for a filter of 2**bits bits, takes them in turn and passes on those that it has seen before.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = np.array([xxhash.xxh64_intdigest(k) for k in {k for k in keys_of(text.as_py(), min_chars)[1] if k is not None}], np.uint64).view(np.int64)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), doc.as_py())), pa.array(np.full(len(own), part.as_py())), pa.array(own)], ["_id", "_part", "hash"])

    flat = keep(named.select("_id", "_part", "text").mapInArrow(hashed, "_id bigint, _part bigint, hash bigint"), "line-hashes")
    ranges = max(1, math.ceil(flat.count() * BITS_PER_LINE / (1 << bits)))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a batch each hash once, so that a line of all documents makes few rows
        for batch in batches:
            hashes, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n > 1)], ["hash", "again"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            hashes, n = np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True)
            flagged = np.zeros(len(hashes), bool)
            flagged[np.searchsorted(hashes, batch.column(0).to_numpy().view(np.uint64)[batch.column(1).to_numpy(zero_copy_only=False)])] = True
            pos = positions(hashes, bits)
            again = (n > 1) | flagged | holds(once, pos)
            put(once, pos)
            # what comes again is twice seen and leaves at once, so a range needs no second filter
            yield pa.RecordBatch.from_arrays([pa.array(hashes[again].view(np.int64))], ["hash"])

    dealt = flat.select("hash").mapInArrow(thinned, "hash bigint, again boolean").repartition(ranges, F.shiftright("hash", 40))
    return flat.join(dealt.mapInArrow(repeated, "hash bigint").distinct(), "hash").select("_id", "_part", "hash")


def line_dedup(docs: DataFrame, min_chars: int = 10, most_bits: int = MOST_BITS) -> DataFrame:
    """Drops each line whose key (trimmed, A-Z lower-cased, of at least min_chars code points) occurs in several documents, except in the smallest doc_id that holds it.

    Returns the columns of docs with text replaced by the kept lines, then n_lines (before dropping) and n_dropped; columns
    of docs with those names are replaced. A null or empty text is one empty line and comes back empty. Rows with the same
    doc_id are one document: a line that only they hold stays in all of them. A null doc_id counts as larger than any
    other, and all rows without one as one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped", "_id", "_part", "_drops", "_suspects")))
    # rows without an id are one document, but each looks for its own lines
    named = docs.withColumn("_id", id_or_last(F.col("doc_id"))).withColumn("_part", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    bits = filter_bits(docs)
    if bits <= most_bits:
        shared = spark.sparkContext.broadcast(twice_seen(docs, min_chars, bits))
        source = named.select("_id", "_part", "text").withColumn("_suspects", F.lit(None).cast("array<bigint>"))
        held = lambda hashes, _: holds(shared.value, positions(hashes, bits))
    else:
        own = suspected_hashes(named, min_chars, min(bits, most_bits)).groupBy("_id", "_part").agg(F.collect_set("hash").alias("_suspects"))
        source = named.select("_id", "_part", "text").join(own, ["_id", "_part"])
        held = lambda hashes, listed: np.isin(hashes, np.array(listed, np.int64).view(np.uint64))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, keys = [], [], []
            for doc, part, text, listed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = list({k for k in keys_of(text, min_chars)[1] if k is not None})
                if own:
                    hit = held(np.array([xxhash.xxh64_intdigest(k) for k in own], np.uint64), listed)
                    found = [k for k, yes in zip(own, hit, strict=True) if yes]
                    ids += [doc] * len(found)
                    parts += [part] * len(found)
                    keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(keys, pa.binary())], ["_id", "_part", "key"])

    suspected = keep(source.mapInArrow(suspects, "_id bigint, _part bigint, key binary"), "suspects")
    first = suspected.groupBy("key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select("key", "_first")
    first = keep(first, "repeats")
    drops = suspected.join(first, "key").where("_id <> _first").groupBy("_id", "_part").agg(F.collect_set("key").alias("_drops"))
    drops = keep(drops, "drops")
    names = docs.columns
    at = names.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines, keys = keys_of(text, min_chars)
                gone = set(drop or ())
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or k not in gone] if gone else lines
                texts.append(b"\n".join(stay).decode("utf-8"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines bigint, n_dropped bigint"
    joined = named.join(drops, ["_id", "_part"], "left").select(*names, "_drops")
    return joined.mapInArrow(kept, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.first IS NOT NULL AND f.first <> l.doc_id AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
