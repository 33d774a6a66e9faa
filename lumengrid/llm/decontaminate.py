r"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Benchmark items are cut into windows of consecutive words. The index holds a posting (term, document, position) for every
place in the corpus of a word that a benchmark item has; it is written once as a table and read for the terms' counts and
for both searches. The rarest terms of each window by their count in the corpus are its anchors. Shifting a posting by its
anchor's offset gives the place where the window would begin. Where both anchors of a window agree on that place the lists
meet, and the place is confirmed on the words of the document itself; where they differ a little it is a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, let, pieces, sha256, small, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists intersected per window before the exact check.
ANCHORS = 2
#: How far offset-adjusted places of a window's anchors may be apart in a proximity match.
SLACK = 5
#: Largest tables, in rows of at most about 100 bytes, that are broadcast (20 MB); beyond them joins shuffle.
SMALL_ROWS = 200_000


def words(text: Column) -> Column:
    return pieces(ascii_lower(text), NOT_WORD)


def key_of(docs: DataFrame) -> DataFrame:
    """docs with _id (the doc_id, or a hash of the text where there is none) and _h (a hash of the text)."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("_h", h).withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), h))


def windows(items: DataFrame, size: int) -> DataFrame:
    """Windows of items: item_id, wid, terms, len; wid is a hash of the words, check another."""
    cut = items.select("item_id", let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.slice(w, i, size)))).alias("cuts"))
    flat = cut.select("item_id", F.explode("cuts").alias("terms")).distinct()
    return flat.select("item_id", F.xxhash64("terms").alias("wid"), F.hash("terms").alias("check"), "terms", F.size("terms").alias("len"))


def postings(docs: DataFrame, vocabulary: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The positional index of docs (_id, _h, text) for the terms of a vocabulary: term, _id, _h, pos (from 0), n_words."""
    split = docs.select("_id", "_h", words(F.col("text")).alias("w"))
    flat = split.select("_id", "_h", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "term"))
    return flat.join(small(vocabulary, vocabulary.count(), limit), "term", "left_semi").select("term", "_id", "_h", "pos", "n_words")


def anchors(index: DataFrame, cuts: DataFrame, n: int = ANCHORS) -> DataFrame:
    """The n rarest words of each window by their count in the index: term, wid, shift, len, n_anchors."""
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    places = cuts.select("wid", "terms", "len").dropDuplicates(["wid"]).select("wid", "len", F.posexplode("terms").alias("shift", "term"))
    ranked = places.join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "shift")))
    return ranked.where(F.col("rank") <= n).select("term", "wid", "shift", "len", F.least("len", F.lit(n)).alias("n_anchors"))


def matches(index: DataFrame, anchored: DataFrame, slack: int = SLACK, limit: int = SMALL_ROWS) -> DataFrame:
    """Where offset-adjusted lists of a window's anchors come within slack: _id, _h, wid, len, n_words, start, distance.

    Lists meet within a text, that is, by _id and _h. Places of one anchor and the next place of the other are compared in
    the order of places, so a document's postings are read once. A window of one word needs that word only. At distance 0
    the window's words may stand at start.
    """
    shifted = index.join(small(anchored, anchored.count(), limit), "term").withColumn("start", F.col("pos") - F.col("shift"))
    order = Window.partitionBy("_id", "_h", "wid").orderBy("start", "shift")
    apart = F.when(F.col("n_anchors") == 1, 0).when(F.lag("shift").over(order) != F.col("shift"), F.col("start") - F.lag("start").over(order))
    return shifted.withColumn("distance", apart).where(F.col("distance") <= slack).select("_id", "_h", "wid", "len", "n_words", "start", "distance")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slack: int = SLACK, limit: int = SMALL_ROWS) -> DataFrame:
    """Marks the words of each document that lie inside an occurrence of a window of an item.

    Returns the columns of docs, then n_words, n_hit, item_ids (sorted as strings), n_near (items with a proximity match,
    exact ones included) and contaminated; columns of docs with those names are replaced. Null and empty texts have no
    words and are clean. Items without words match nothing, and with no items at all every document is clean. Rows with
    the same doc_id are each judged on their own text, and so are rows with a null doc_id. A window has two anchors, so a
    passage with one of them replaced is no proximity match. Tables of more than limit rows are shuffled, not broadcast.
    """
    own = ("n_words", "n_hit", "item_ids", "n_near", "contaminated")
    docs = key_of(docs.select(*(c for c in docs.columns if c not in (*own, "_id", "_h", "_found", "_hit"))))
    cuts = keep(windows(items.select("item_id", "text"), size), "windows")
    vocabulary = keep(cuts.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    index = keep(postings(docs, vocabulary, limit), "postings")
    near = keep(matches(index, keep(anchors(index, cuts), "anchors"), slack, limit), "matches")
    names = cuts.select("wid", "item_id")
    n_names = names.count()
    # which items come near: by document and window first, then by item
    close = near.select("_id", "_h", "wid").distinct().join(small(names, n_names, limit), "wid").select("_id", "_h", "item_id").distinct()
    close = keep(close.groupBy("_id", "_h").agg(F.count("*").alias("n_near")), "near")
    # exact places, confirmed on the words of the documents that have any
    exact = near.where("distance = 0 AND start >= 0 AND start + len <= n_words").join(small(cuts.select("wid", "check").distinct(), n_names, limit), "wid")
    found = keep(exact.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "len", "wid", "check")).alias("_found")), "places")
    n_places = near.where("distance = 0").count()

    def judged(w: Column) -> Column:
        at = lambda c: F.slice(w, c["start"] + 1, c["len"])
        true = F.filter("_found", lambda c: (c["start"] + c["len"] <= F.size(w)) & (F.xxhash64(at(c)) == c["wid"]) & (F.hash(at(c)) == c["check"]))
        hit = F.array_distinct(F.flatten(F.transform(true, lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
        return F.struct(F.size(hit).cast("bigint").alias("n_hit"), F.array_distinct(F.transform(true, lambda c: c["wid"])).alias("wids"))

    held = docs.select("_id", "_h", "text").join(small(found, n_places, limit), ["_id", "_h"])
    hits = keep(held.select("_id", "_h", let(words(F.col("text")), judged).alias("j")).select("_id", "_h", "j.*").where("n_hit > 0").dropDuplicates(["_id", "_h"]), "hits")
    listed = hits.select("_id", "_h", F.explode("wids").alias("wid")).join(small(names, n_names, limit), "wid").groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    verdicts = keep(hits.drop("wids").join(listed, ["_id", "_h"]), "verdicts")
    out = docs.join(small(verdicts, verdicts.count(), limit), ["_id", "_h"], "left").join(small(close, close.count(), limit), ["_id", "_h"], "left")
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    plain = [c for c in docs.columns if c not in ("_id", "_h")]
    return out.select(*plain, F.size(words(F.col("text"))).cast("bigint").alias("n_words"), zero("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), zero("n_near"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), sha256(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated", "n_near")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN win USING (phrase)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
-- proximity: the two rarest words of each window, at most 5 apart from where the window has them
terms AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS t FROM win),
freq AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
slots AS (SELECT phrase, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS shift, least(len(t), 2) AS k FROM terms),
anchors AS (SELECT phrase, slots.term, shift, k FROM slots LEFT JOIN freq USING (term) QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY coalesce(n, 0), shift) <= 2),
posts AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
lists AS (SELECT doc_id, phrase, k, shift, pos - shift AS start FROM posts JOIN anchors USING (term)),
gaps AS (SELECT doc_id, phrase, CASE WHEN k = 1 THEN 0 WHEN lag(shift) OVER o <> shift THEN start - lag(start) OVER o END AS distance FROM lists WINDOW o AS (PARTITION BY doc_id, phrase ORDER BY start, shift)),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM gaps JOIN win USING (phrase) WHERE distance <= 5 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)
"""
