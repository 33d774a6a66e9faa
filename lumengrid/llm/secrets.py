r"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every text version is a blob named by its SHA-256. The ledger holds the findings of each (blob, rule version) pair that
was scanned; only pairs not in it are scanned, once however many paths hold the blob, and findings join back to all
paths. Places of matches come from splitting the text at the pattern and adding up the lengths of gaps and matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_or_last, keep, sha256, small, table


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the least length of a group (0: the whole match); shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: In the order in which spans that start at the same place are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run of hex digits is maximal, so asking for its length in the pattern finds the same runs
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = 3
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
STEP = "array<struct<gap:int,size:int,ok:boolean>>"
#: Copies of earlier texts, as pairs of numbers, that are sent to all tasks so that texts need no shuffle (32 MB); beyond, they are shuffled.
SMALL_COPIES = 1_000_000


def steps(text: Column, rule: Rule) -> Column:
    """Of each leftmost non-overlapping match, in order: code points since the one before, its own, and whether the rule accepts it."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gaps"), whole.alias("whole"), group.alias("group"))
    # there is one gap more than there are matches
    some = F.filter(F.transform(parts, lambda x: F.struct(F.length(x["gaps"]).alias("gap"), F.length(x["whole"]).alias("size"), (F.length(x["group"]) >= rule.least).alias("ok"))), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(rule.pattern), some).otherwise(F.array().cast(STEP))


def ledger_of(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the pairs of blobs and rules that ledger lacks.

    blobs: blob (hex SHA-256), text. A rule with a new version is scanned again; older rows stay valid for theirs. A match
    is placed by adding up what comes before it: one row a match, summed in a window over a blob and rule, so a text of
    many matches costs in proportion.
    """
    pairs = blobs.select("blob", "text")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_seen"))
        pairs = pairs.join(seen, "blob", "left")
    else:
        pairs = pairs.withColumn("_seen", F.lit(None).cast("array<string>"))
    done = lambda r: F.coalesce(F.array_contains("_seen", f"{r.kind}:{r.version}"), F.lit(False))
    scanned = F.array(*(F.when(~done(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("rank"), steps(F.col("text"), r).alias("steps"))) for i, r in enumerate(rules)))
    found = pairs.select("blob", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")
    found = keep(found, "scanned")
    by = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flat = found.select("blob", "kind", "rank", F.posexplode("steps").alias("i", "s")).select("blob", "kind", "rank", "i", "s.*").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by).cast("int"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end")
    placed = flat.where("ok").groupBy("blob", "rank").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(SPAN)
    out = found.where(F.size("steps") > 0).select("blob", "kind", "version", "rank").join(placed, ["blob", "rank"], "left")
    return out.select("blob", "kind", "version", F.coalesce("spans", none).alias("spans")).unionByName(found.where(F.size("steps") == 0).select("blob", "kind", "version", none.alias("spans")))


def blobs_of(docs: DataFrame) -> DataFrame:
    """One row per distinct text: blob, text. The row with the smallest id holds the text that is scanned."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(id_or_last(F.col("doc_id")).alias("_id"), text.alias("text"), sha256(text).alias("blob")).withColumn("_h", F.xxhash64("blob"))
    paths = keep(named.select("_id", "blob", "_h"), "paths")
    first = paths.groupBy("blob", "_h").agg(F.min("_id").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keep(paths.join(first, ["blob", "_h"]).where("_id > _first").select("_id", "_h").distinct(), "copies")
    again = keep(paths.groupBy("_id", "_h").count().where("count > 1").select("_id", "_h"), "again")
    held = named.join(small(copies, copies.count(), SMALL_COPIES), ["_id", "_h"], "left_anti")
    # rows that have both the id and the text of another: one stays
    n_again = again.count()
    if n_again:
        again = small(again, n_again, SMALL_COPIES)
        held = held.join(again, ["_id", "_h"], "left_anti").unionByName(held.join(again, ["_id", "_h"], "left_semi").dropDuplicates(["blob"]))
    return held.select("blob", "text")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings for every document, and the ledger rows that were added.

    The first result has doc_id, blob and spans (start, rank, kind, end; sorted by start, then by the rules' order). Null
    texts are empty. Equal texts are one blob and are scanned once. Rows with the same doc_id keep a result each. An
    empty table gives empty results. Pairs that the given ledger holds are not scanned again.
    """
    paths = docs.select("doc_id", sha256(F.coalesce("text", F.lit(""))).alias("blob"))
    added = keep(ledger_of(blobs_of(docs), rules, ledger), "ledger")
    current = added if ledger is None else added.unionByName(ledger.select(added.columns))
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    # blobs without a finding need no join: their paths get an empty list
    found = current.where(wanted).where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = keep(found, "findings")
    out = keep(paths, "named").join(found, "blob", "left")
    return out.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), added


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < BASE)
    return out.select("doc_id", n("assign"), n("access"), n("hex"), sha256(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _duck(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(range(1, i + 1), lambda j: length(g[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0), 'n': length(m[i]), 'k': length(v[i])}})) AS x
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))"""


ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (\n"
    + "\nUNION ALL\n".join(f"SELECT doc_id, rank, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM ({_duck(r, i)}) WHERE x.k >= {r.least}" for i, r in enumerate(RULES))
    + """
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
)
