"""Helpers that the corpus operators share: scratch tables, text expressions, hash splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.session import materialise as keep
from lumengrid.session import scratch, table

__all__ = ["ascii_lower", "held_out", "id_or_last", "keep", "labelled", "let", "map_texts", "pieces", "remainder", "sampled", "sampled_within", "scratch", "sha256", "small", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest id: rows without a doc_id sort behind all others.
NO_ID = 9223372036854775807


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; plain ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column, separators: str) -> Column:
    """The non-empty pieces of a text between matches of a pattern; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, r: int) -> Column:
    """True where the row must not be learned from; a null id is not held out."""
    return F.coalesce(remainder(doc_id, n) == r, F.lit(False))


def id_or_last(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID))


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df marked for broadcast if its checked row count is within the bound; otherwise left to a shuffle join."""
    return F.broadcast(df) if rows <= bound else df


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def map_texts(docs: DataFrame, score: Callable[[list], dict], added: str) -> DataFrame:
    """Appends the columns named in the schema string added, which score makes from each batch of texts.

    Columns of docs with those names are replaced. Runs in Arrow batches, on whole texts.
    """
    import pyarrow as pa

    new = [x.split()[0] for x in added.split(",")]
    docs = docs.select(*(c for c in docs.columns if c not in new))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c]) for c in new)], [*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {added}")


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most of the rows, chosen by a hash of their key; all of them if they are fewer."""
    n = rows.count()
    share = min(1.0, most / max(1, n))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(share * 1_000_000))


def sampled_within(rows: DataFrame, most: int, chars: int, by: str | None = None) -> DataFrame:
    """At most about most rows with a doc_id, chosen by its hash, that have at most chars code points of text together.

    Texts that alone have over an eighth of chars come after all others, the shortest first, so that none of them keeps
    others out: as long as texts are left, at least seven eighths of chars are used.
    With by, every value of that column has an equal part of most, as far as it has rows.
    """
    if by:
        n = {x[by]: x["count"] for x in rows.groupBy(by).count().collect()}  # a few classes
        share, left, part = {}, len(n), most
        for value, count in sorted(n.items(), key=lambda x: x[1]):  # what the small ones leave is for the others
            room = part / left
            share[value] = min(1.0, room / count)
            part, left = part - min(count, room), left - 1
        limit = F.lit(0)
        for value, s in share.items():
            limit = F.when(F.col(by) == value, int(s * 1_000_000)).otherwise(limit)
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < limit)
    else:
        rows = sampled(rows, "doc_id", most)
    size = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("size"))  # about most rows
    wide = F.when(F.col("size") > chars // 8, F.col("size")).otherwise(0)
    upto = F.sum("size").over(Window.orderBy(wide, F.xxhash64(F.lit("size"), "doc_id"), "doc_id"))
    ids = size.withColumn("upto", upto).where(F.col("upto") <= chars).select("doc_id")
    return rows.join(F.broadcast(ids), "doc_id")


def labelled(docs: DataFrame, labels: DataFrame, label: str, n: int, r: int, most: int, chars: int | None = None) -> DataFrame:
    """doc_id, text and label (0 or 1) of the labelled documents to learn from, about most of them, with at most chars code points.

    Rows whose remainder modulo n is r are left out. Of several labels of one id the largest counts.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), n, r))
    chosen = sampled(wanted.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "doc_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has about most rows at the most
    return rows if chars is None else sampled_within(rows, 2 * most, chars)
