"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte string of the given size that starts at a second place has its own k bytes of the smallest hash there too, at the
same offset. So a text is cut into contexts: for each such place, its anchor, the bytes that any string with this anchor
can reach. Only anchors that occur twice matter. Where all contexts of an anchor are equal they repeat as a whole, which
hashes tell. Where they differ, one context of each kind goes, with the others of its anchor, into a suffix array: all their
suffixes in the order of their first bytes, equal ones in the order of their places. There the previous smaller place of a
suffix that has an earlier match is the neighbour before it, so the longest previous factor reaches the size just where
the neighbour shares that many bytes; the neighbour after it tells of later matches. An anchor with very many kinds of
contexts (the edge of a licence that a third of all texts have) is split by longer and longer common cores, down to single
strings, so no task holds more than a bounded part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .runs import Substrings, mixed, text_runs

#: Bytes of an anchor.
ANCHOR = 64
#: Kinds of contexts of one anchor that a suffix array takes; anchors with more are split.
MOST_KINDS = 4096
#: Bytes of contexts that one suffix array takes at once: ranks of three parts must fit 64 bits.
MOST_BYTES = 1 << 21
ROWS = "_id bigint, _t binary, lo int, hi int, h bigint, c bigint, n int, skip int"


# anchors and contexts


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, from running minima of blocks, forward and backward."""
    n = len(values) - width + 1
    pad = np.full(-len(values) % width + width, np.iinfo(values.dtype).max, values.dtype)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(held: np.ndarray, starts: np.ndarray, size: int, k: int) -> list[np.ndarray]:
    """text, lo, hi (places in the run), h, c and skip of the contexts of all texts of a run that have size bytes.

    skip is how many bytes the beginning of the text cuts off.
    """
    if len(held) < size:
        return [np.zeros(0, np.int64)] * 6
    h = Substrings(held).fixed(k)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    placed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones is the least
    least = window_minima(placed, size - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    first = np.arange(len(least))
    text = np.searchsorted(starts, first, "right") - 1
    least, text = (x[first + size <= starts[text + 1]] for x in (least.astype(np.int64), text))
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at, text = least[new], text[new]
    lo, hi = np.maximum(at + k - size, starts[text]), np.minimum(at + size, starts[text + 1])
    return [text, lo, hi, h[at].view(np.int64), Substrings(held, 1).of(lo, hi).view(np.int64), lo - (at + k - size)]


def _cut(size: int, k: int, first: bool):
    """Contexts of each text, one row for each kind in it; places that repeat inside a text go as spans, without h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, held, starts in text_runs(batch.column(2)):
                found = anchors(held, starts, size, k)
                if not len(found[0]):
                    continue
                text, lo, hi, h, c, skip = (x[np.lexsort((found[1], found[4], found[3], found[0]))] for x in found)
                apart = np.ones(len(text), bool)
                head = apart.copy()
                head[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                apart[1:] = head[1:] | (lo[1:] != lo[:-1])  # in a short text one place can be the context of two equal anchors
                text, lo, hi, h, c, skip, head = (x[apart] for x in (text, lo, hi, h, c, skip, head))
                base = starts[text]
                run_of = np.cumsum(head) - 1
                n = np.bincount(run_of)
                sure = ~head if first else n[run_of] > 1
                where, covered = np.flatnonzero(head), np.flatnonzero(sure)
                covered = covered[np.lexsort((lo[covered], text[covered]))]
                s_text, s_lo, s_hi = merged(text[covered], lo[covered], hi[covered])
                of = pa.array(row + np.concatenate([text[where], s_text]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate([lo[where] - base[where], s_lo - starts[s_text]]), pa.int32()), pa.array(np.concatenate([hi[where] - base[where], s_hi - starts[s_text]]), pa.int32()),
                        *(pa.array(np.concatenate([x[where], np.zeros(len(s_text), np.int64)]), mask=np.arange(len(of)) >= len(where)) for x in (h, c)), *(pa.array(np.concatenate([x, np.zeros(len(s_text), np.int64)]), pa.int32()) for x in (np.minimum(n, 1 if first else 2), skip[where])),
                    ],
                    ["_id", "_t", "lo", "hi", "h", "c", "n", "skip"],
                )

    return run


def merged(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each owner as one; spans come in the order of owner and lo."""
    if not len(of):
        return of, lo, hi
    gap = int(hi.max()) + 1
    end = np.maximum.accumulate(hi + of * gap) - of * gap  # owners ascend, so an owner's first end is beyond all before
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (lo[1:] > end[:-1])
    return of[new], lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(of) - 1)]


# suffix arrays


def ranked(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    step = np.ones(len(keys), np.int64)
    step[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step) - 1
    return out


def suffix_ranks(held: np.ndarray, size: int) -> np.ndarray:
    """Ranks of all suffixes by their first size bytes; after the end come bytes of 255, which no text has."""
    n = len(held)
    wide = np.concatenate([held, np.full(size + 8, 255, np.uint8)])
    words = np.zeros(n + size, np.uint64)
    length = min(8, size)
    for j in range(length):
        words |= wide[j : n + size + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    rank = ranked(words)
    while length < size:  # ranks of three parts give the rank of a whole of three times the length, or of just the size
        whole = min(3 * length, size)
        last = n + size - 1
        part = lambda d: rank[np.minimum(np.arange(n + size) + d, last)]
        middle = min(length, whole - length)
        rank = ranked((rank << 42) | (part(middle) << 21) | part(whole - length))
        length = whole
    return rank[:n]


def previous_factors(held: np.ndarray, starts: np.ndarray, place: np.ndarray, many: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes of contexts that have size bytes: whether these match earlier, and whether they match anywhere else.

    place is where each context begins in the corpus; many tells whether it stands at more places than that. Suffixes are
    sorted by their first size bytes and their places; the previous smaller place of one with an earlier match is then the
    neighbour before it. Contexts can overlap, so one place may have several suffixes.
    """
    n = len(held)
    ranks = suffix_ranks(held, size)
    context = np.searchsorted(starts, np.arange(n), "right") - 1
    whole = np.flatnonzero(np.arange(n) + size < starts[context + 1])  # the last byte of a context is its separator
    at = place[context[whole]] + whole - starts[context[whole]]
    by = np.lexsort((at, ranks[whole]))
    order, at = whole[by], at[by]
    new_rank = np.ones(len(order), bool)
    new_rank[1:] = ranks[order][1:] != ranks[order][:-1]
    new_place = new_rank.copy()
    new_place[1:] |= at[1:] != at[:-1]
    run, nth = np.cumsum(new_rank) - 1, np.cumsum(new_place)
    begins = np.flatnonzero(new_rank)
    later_place = nth > nth[begins][run]
    places = np.bincount(run, new_place) + np.bincount(run, many[context[order]])
    earlier, other = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order], other[order] = later_place, places[run] > 1
    return earlier, other


def _factors(size: int, first: bool):
    """Spans of contexts (h, c, n, o1, ot, o2, ctx, in the order of h) that match others of their anchor."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        h, c, n, o1, ot, o2 = (np.array([r[i] for r in rows], np.int64) for i in range(6))
        texts = [r[6] + b"\xff" for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        owners = np.unique(np.stack([o1, ot], 1), axis=0, return_inverse=True)[1].ravel()
        earlier, other = previous_factors(np.frombuffer(b"".join(texts), np.uint8), starts, (owners << 40) + o2, n > 1, size)
        at = np.flatnonzero(earlier if first else other)
        of = np.searchsorted(starts, at, "right") - 1
        of, lo, hi = merged(of, at - starts[of], at - starts[of] + size)
        return pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(c[of]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["h", "c", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if rows and x[0] != rows[-1][0] and total > MOST_BYTES // 3:
                    yield solved(rows)
                    rows, total = [], 0
                if rows and x[:2] == rows[-1][:2]:  # equal documents give a kind twice
                    continue
                rows.append(x)
                total += len(x[6]) + 1
        if rows:
            yield solved(rows)

    return run


# the plan


KIND = ["h", "c", "n", "o1", "ot", "o2", "skip"]


def _contexts(own: int):
    """Cuts contexts out of texts: rows (owner..., text, list of kinds with lo and hi)."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*KIND, "ctx")}
            for text, wanted in zip(batch.column(own).to_pylist(), batch.column(own + 1).to_pylist(), strict=True):
                b = text if isinstance(text, bytes) else text.encode()
                for w in wanted:
                    for k in KIND:
                        out[k].append(w[k])
                    out["ctx"].append(b[w["lo"] : w["hi"]])
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ctx" else pa.int64()) for k, v in out.items()})

    return run


def _parts(size: int, block: int):
    """Contexts of crowded anchors in parts of block strings each: the part's core, common to its strings, is the new anchor.

    Parts are counted from where the context would begin in a longer text, so that equal strings are in equal parts.
    """

    def run(batches):
        for batch in batches:
            n, ot, o2, skip = (batch.column(i).to_numpy() for i in (2, 4, 5, 6))
            for row, end, held, starts in text_runs(batch.column(7), 1 << 18):
                one, two, cut = Substrings(held), Substrings(held, 1), skip[row:end]
                strings = np.diff(starts) - size + 1
                low, high = cut // block, (cut + strings - 1) // block
                parts = high - low + 1
                of = np.repeat(np.arange(end - row), parts)
                first = (low[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * block - cut[of]  # may be before the text
                a = np.maximum(first, 0)
                z = np.minimum(first + block, strings[of]) - 1 + size
                core = one.of(starts[of] + first + block - 1, starts[of] + first + size)
                at = pa.array(row + of)
                take = lambda i: batch.column(i).take(at)  # noqa: B023, E731
                ints = {"lo": a, "hi": z, "n": n[row + of], "skip": a - first}
                longs = {"h": core.view(np.int64), "c": two.of(starts[of] + a, starts[of] + z).view(np.int64), "o2": o2[row + of] + a}
                columns = {"oh": take(0), "oc": take(1), "o1": take(3), "ot": take(4)} | {k: pa.array(v, pa.int32()) for k, v in ints.items()} | {k: pa.array(v, pa.int64()) for k, v in longs.items()}
                yield pa.RecordBatch.from_pydict({k: columns[k] for k in PARTS})

    return run


PARTS = ["oh", "oc", "lo", "hi", *KIND]


def _spans(rows: DataFrame, texts: DataFrame, owner: list[str], size: int, block: int, first: bool, most: int, whole: bool = True) -> DataFrame:
    """Spans (owner, start, end) of contexts that repeat. rows: owner, lo, hi, and the columns KIND; texts: owner, text.

    With whole every row is a place of its own; else rows are parts of contexts that may overlap, and a place counts once.
    """
    order = F.struct("o1", "ot", "o2")
    total = F.sum("n") if whole else F.when(F.min(order) != F.max(order), F.lit(2)).otherwise(F.max("n"))
    seen = rows.groupBy("h").agg(total.alias("total"), (F.min("c") == F.max("c")).alias("single"), F.min(order).alias("first"))
    twice = seen.where("total >= 2").select("h", "single", "first")
    suspects = keep(rows.join(twice, "h"), "suspects")
    span = lambda lo, hi: [*owner, lo.cast("int").alias("start"), hi.cast("int").alias("end")]
    later = (order != F.col("first")) if first else F.lit(True)
    out = suspects.where(F.col("single") & later).select(*span(F.col("lo"), F.col("hi")))
    several = suspects.where("NOT single").drop("first", "single")
    least = F.min(F.struct("o1", "ot", "o2", *owner, "lo", "hi", "skip"))
    kinds = keep(several.groupBy("h", "c").agg(total.cast("bigint").alias("n"), least.alias("x")).select("h", "c", "n", "x.*"), "kinds")
    crowded = keep(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("h"), "crowded")
    wanted = kinds.groupBy(*owner).agg(F.collect_list(F.struct("lo", "hi", *KIND)).alias("wanted"))
    cut = texts.join(wanted, owner).select(*owner, "text", "wanted")
    contexts = keep(cut.mapInArrow(_contexts(len(owner)), ", ".join(f"{k} bigint" for k in KIND) + ", ctx binary"), "contexts")
    few, found = contexts, None
    if not crowded.isEmpty():
        few = contexts.join(crowded, "h", "left_anti")
        many = contexts.join(crowded, "h", "left_semi").dropDuplicates(["h", "c"])  # equal documents give a kind twice
        smaller = -(-block // 3)
        parts = keep(many.select(*KIND, "ctx").mapInArrow(_parts(size, smaller), "oh bigint, oc bigint, lo int, hi int, h bigint, c bigint, n int, o1 bigint, ot bigint, o2 bigint, skip int"), "parts")
        own = many.select(F.col("h").alias("oh"), F.col("c").alias("oc"), F.col("ctx").alias("text"))
        found = _spans(parts, own, ["oh", "oc"], size, smaller, first, most, False).toDF("h", "c", "a", "b")
    by_suffix = few.select("h", "c", "n", "o1", "ot", "o2", "ctx").repartition("h").sortWithinPartitions("h", "c").mapInArrow(_factors(size, first), "h bigint, c bigint, a int, b int")
    inside = by_suffix if found is None else by_suffix.unionByName(found)
    by_kind = kinds.select("h", "c", F.col("n").alias("of_kind"), order.alias("first"))
    placed = several.join(by_kind, ["h", "c"])
    others = placed.where(order != F.col("first")) if first else placed.where("of_kind > 1")
    some = placed.where(order == F.col("first")) if first else placed.where("of_kind = 1")
    some = some.join(inside, ["h", "c"])
    return keep(out.unionByName(others.select(*span(F.col("lo"), F.col("hi")))).unionByName(some.select(*span(F.col("lo") + F.col("a"), F.col("lo") + F.col("b")))), "spans")


def _removed(names: list[str], at: int, spans: int):
    """The texts without their spans."""
    import hashlib

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(at).to_pylist(), batch.column(spans).to_pylist()
            n_bytes, n_removed, kept, sums, runs = [], [], [], [], []
            for text, cut in zip(texts, cuts, strict=True):
                b = (text or "").encode()
                one = []
                if cut:
                    lo, hi = (np.array(x, np.int64) for x in zip(*sorted((c["start"], c["end"]) for c in cut), strict=True))
                    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
                    one = list(zip(lo.tolist(), hi.tolist(), strict=True))
                edges = [0, *(x for s in one for x in s), len(b)]
                rest = b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if one else b
                n_bytes.append(len(b))
                n_removed.append(len(b) - len(rest))
                kept.append(rest)
                sums.append(hashlib.sha256(rest).hexdigest())
                runs.append([{"start": x, "end": y} for x, y in one])
            new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in runs], pa.int64()), pa.array(sums), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != spans), *new], [*names, *NEW])

    return run


NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]


def suffix_dedup(docs: DataFrame, size: int = 200, keep_first: bool = False, k: int = ANCHOR, most: int = MOST_KINDS) -> DataFrame:
    """Removes the bytes that a repeated string of size bytes covers, within and across texts.

    Returns the columns of docs, then n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes that
    are left; a cut can fall inside a character) and spans (start, end; end exclusive); columns of docs with those names are
    replaced. All copies go; with keep_first only later ones, so the first, by doc_id and place, stays. Texts are judged as
    they came in. Null and empty texts have 0 bytes; texts shorter than size lose nothing. Repeated doc_ids are told apart
    by their texts, null doc_ids likewise, and with keep_first come in the order of a hash; equal rows with one id are one
    place, so keep_first keeps both of them. An empty table gives an empty table.
    """
    k = min(k, max(1, size // 2))
    most = max(1, min(most, (MOST_BYTES * 2 // 3 - size) // (2 * size - k + 1)))
    kept = [c for c in docs.columns if c not in (*NEW, "_id", "_t", "_spans")]
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    docs = docs.select(*kept, key.alias("_t"), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("_id"))
    long_ones = docs.where(F.octet_length("text") >= size).select("_id", "_t", "text")
    rows = keep(long_ones.mapInArrow(_cut(size, k, keep_first), ROWS), "anchors")
    inside = rows.where("h IS NULL").select("_id", "_t", F.col("lo").alias("start"), F.col("hi").alias("end"))
    half = F.conv(F.substring(F.hex("_t"), 1, 15), 16, 10).cast("bigint")
    placed = rows.where("h IS NOT NULL").withColumns({"o1": F.col("_id"), "ot": half, "o2": F.col("lo").cast("bigint")})
    spans = inside.unionByName(_spans(placed, long_ones, ["_id", "_t"], size, size - k + 1, keep_first, most))
    of_text = spans.groupBy("_id", "_t").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = docs.join(of_text, ["_id", "_t"], "left").select(*kept, "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    added = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start: int, end: int>>"
    return joined.mapInArrow(_removed(kept, kept.index("text"), len(kept)), f"{schema}, {added}")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows by their hash over the hexadecimal form, whose substrings are those of the bytes; in blocks, as substr counts from the beginning.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, j, substr(x, 400 * j + 1, 798) AS y FROM (SELECT r, x, unnest(range(0, greatest(0, length(x) // 400))) AS j FROM d)),
w AS (SELECT r, 200 * j + k AS i, md5_number(substr(y, 2 * k + 1, 400)) AS g FROM (SELECT r, j, y, unnest(range(0, length(y) // 2 - 199)) AS k FROM blocks)),
again AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
hit AS (SELECT r, i FROM w JOIN again USING (g)),
steps AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true)::INT AS new FROM hit),
isles AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS isle FROM steps),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM isles GROUP BY r, isle),
gaps AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS f FROM (SELECT r, a, b FROM spans UNION ALL SELECT r, length(x) // 2, NULL FROM d)),
kept AS (SELECT r, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY r)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
