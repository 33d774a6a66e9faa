r"""Quality rules: text statistics per document, and line frequency across the documents of a host.

Lines are normalised (stripped of blanks at both ends, A-Z lower-cased, digits as 0) and hashed; a line held by too many distinct documents of
one host is boilerplate there. A document that loses too much to removed lines is rejected. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep, let, pieces, table

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: A line is boilerplate of a host if at least LEAST_DOCS of its documents, and more than MOST_SHARE of them, hold it.
LEAST_DOCS, MOST_SHARE = 5, 0.01
#: A document is depleted if removed lines held more than this share of its words.
MOST_REMOVED = 0.5
MIN_WORDS, MOST_REPEATED_PERCENT = 20, 30


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """How many words lie in windows of n words that occur twice or more in the list."""

    def neighbours(s: Column) -> Column:
        # of sorted (key, place) pairs those with a neighbour of the same key
        return F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))

    def covered(s: Column) -> Column:
        places = F.array_sort(F.transform(s, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b))

    def repeats(h: Column) -> Column:
        hashed = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i")))), neighbours)
        # equal hashes are confirmed on the words
        named = F.array_sort(F.transform(hashed, lambda x: F.struct(F.array_join(F.slice(w, x["i"], n), " ").alias("h"), x["i"].alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(named, neighbours), covered))

    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n))))
    return F.when(F.size(w) < n, F.lit(0)).otherwise(let(windows, repeats))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.btrim(ascii_lower(line), F.lit(BLANKS)), "[0-9]", "0"))


def base_columns(text: Column) -> Column:
    """Struct of the counts that need no other document, and of lines (hash and words of each line with a word)."""
    # once joined by single spaces the words' code points are all but the spaces
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0), lambda x: F.struct(x.alias("line"), F.size(pieces(x, BLANK)).alias("n")))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.length(F.array_join(w, "")).cast("bigint")).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            (F.size(x) - F.size(F.array_distinct(F.transform(x, lambda y: y["line"])))).cast("bigint").alias("n_dup_lines"),
            F.transform(x, lambda y: F.struct(line_hash(y["line"]).alias("h"), y["n"].alias("n"))).alias("lines"),
        )

    return F.struct(let(pieces(text, BLANK), of).alias("w"), let(lines, of_lines).alias("l"))


def frequent(lines: DataFrame, hosts: DataFrame, least_docs: int, most_share: float) -> DataFrame:
    """host and h of the lines that too many documents of a host hold. lines: host, h, doc_id; hosts: host, doc_id."""
    # distinct documents by (host, line, document) first, so a line that all documents hold is counted from many tasks
    per_line = lines.select("host", "h", "doc_id").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    per_host = hosts.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    over = per_line.where(F.col("n_docs") >= least_docs).join(per_host, "host").where(F.col("n_docs") > most_share * F.col("host_docs"))
    return keep(over.select("host", "h"), "frequent")


def without_lines(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE) -> DataFrame:
    """docs with each text's lines that are frequent in its host removed; the others stay as they are. A null text stays null."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    named = docs.withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("\x01")), "_h": F.xxhash64("text")})
    held = F.transform(F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0), line_hash)
    lines = keep(named.select(F.col("_host").alias("host"), "doc_id", "_h", F.explode(F.array_distinct(held)).alias("h")), "lines")
    over = frequent(lines, named.select(F.col("_host").alias("host"), "doc_id"), least_docs, most_share)
    # a text's own frequent lines, by the text's hash: equal texts of a host lose the same lines
    gone = lines.join(over, ["host", "h"]).groupBy(F.col("host").alias("_host"), "_h").agg(F.collect_set("h").alias("_gone"))
    out = named.join(gone, ["_host", "_h"], "left")
    stay = F.array_join(F.filter(parts, lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) == 0) | ~F.array_contains("_gone", line_hash(x))), "\n")
    return out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(stay)).select(docs.columns)


def quality_rules(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, most_share: float = MOST_SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """Text statistics of each document, words lost to lines that are frequent in its host, and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept. A null
    or empty text has no words and fails the base rules. Rows with the same doc_id are one document when lines are
    counted; each row is judged on its own text. A null host is a host of its own, a null doc_id a document of its own
    that all rows without an id share. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), base_columns(text).alias("b"))
    rows = rows.select("doc_id", "host", "b.w.*", "b.l.*", F.monotonically_increasing_id().alias("row"))
    rows = keep(rows, "statistics")
    lines = rows.select("row", "doc_id", F.coalesce("host", F.lit("\x01")).alias("host"), F.explode("lines").alias("x")).select("row", "doc_id", "host", "x.h", "x.n")
    over = frequent(lines, rows.select(F.coalesce("host", F.lit("\x01")).alias("host"), "doc_id"), least_docs, most_share)
    lost = lines.join(over, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("n").alias("removed_words"))
    n, removed = F.col("n_words"), F.coalesce("removed_words", F.lit(0)).cast("bigint")
    out = rows.drop("lines", "host").join(lost, "row", "left").withColumn("removed_words", removed)
    out = out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= most_removed * n)).drop("row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


_W = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, {_W} AS w FROM d),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS t FROM d),
lw AS (SELECT doc_id, host, t, len({_W}) AS n FROM l),
lines AS (SELECT doc_id, host, t AS line, regexp_replace(translate(trim(t, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS k, n FROM lw WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
freq AS (SELECT host, k FROM lines JOIN hosts USING (host) GROUP BY host, k, hosts.n HAVING count(DISTINCT doc_id) >= {LEAST_DOCS} AND count(DISTINCT doc_id) > {MOST_SHARE} * hosts.n),
lost AS (SELECT doc_id, sum(n) AS n FROM lines JOIN freq USING (host, k) GROUP BY doc_id),
a AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND removed_words <= {MOST_REMOVED} * n_words AS kept FROM f
"""
