r"""Mixing documents to target weights of soft domains, in DataFrame operations only.

A naive Bayes classifier, fitted on a table of labelled documents over binned features of the text, gives every document
a posterior over domains. Features are its shape and, for each domain, how many beginnings of words it has that hardly
occur elsewhere (strong cues) or that occur there more often (weak cues). Each document then gets a rate (how often it should be read); rates are not negative and make
the expected tokens of each domain match their targets in the sense of least squares, with a slight pull to one. The fit
is projected gradient descent. A gradient depends on a document only through its posterior, so documents with the same
posterior share a rate: each step is one distributed sum over those groups and moves their rates, which the documents get
by a join at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_last, keep, let, pieces, sampled, small, table

BLANK = r"[\x20\x09-\x0D]+"
#: Shares of tokens that the mix should have.
TARGETS = {"clean": 0.97, "toxic": 0.03, "low": 0.0}
#: Bins of each feature, and features of a text's shape; two more for each domain count its cues.
BINS, SHAPES = 12, 5
#: A cue is strong if, were all domains of one size, so much of its documents would be of its own.
STRONG = 0.97
#: Beginnings of words that tell a domain: so many at most, learned from about so many labelled documents.
CUES, CUE_LETTERS, CUE_DOCS, CUE_LEAST, CUE_Z = 256, 8, 6_000, 4, 2.5
STEPS, TOLERANCE, PULL = 60, 1e-4, 1e-3
#: Steps after which the groups' rates are written.
STEPS_HELD = 10
#: Largest table of groups, in rows of about 50 bytes, that is broadcast.
SMALL_ROWS = 200_000


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents: low quality, else toxic, else clean."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return known.select("doc_id", F.when(F.col("q") == 0, "low").when(F.col("t") == 1, "toxic").otherwise("clean").alias("domain"))


def _log_bin(x: Column, unit: float) -> Column:
    """A bin of logarithmic width for a quantity of at least 0."""
    return F.least(F.lit(BINS - 1), F.floor(F.log2(1 + x / unit)).cast("int"))


def _stems(w: Column) -> Column:
    return F.array_distinct(F.transform(w, lambda x: F.lower(F.substring(x, 1, CUE_LETTERS))))


def cues(docs: DataFrame, labelled: DataFrame, names: list[str]) -> list[list[str]]:
    """For each domain the word beginnings that speak most for it, strong and weak ones, from a bounded sample of labelled documents."""
    chosen = sampled(labelled, "doc_id", CUE_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.select("domain", F.explode(_stems(pieces(F.col("text"), BLANK))).alias("stem"))
    count = lambda d: F.sum(F.when(F.col("domain") == d, 1).otherwise(0))
    per = keep(found.groupBy("stem").agg(F.count("*").alias("n"), *(count(d).alias(f"d{i}") for i, d in enumerate(names))).where(F.col("n") >= CUE_LEAST), "cues")
    sizes = {x.domain: x["count"] for x in chosen.groupBy("domain").count().collect()}
    total, out = sum(sizes.values()), []
    for i, d in enumerate(names):
        inside, outside = sizes.get(d, 0), total - sizes.get(d, 0)
        a, b = F.col(f"d{i}") + 0.5, F.col("n") - F.col(f"d{i}") + 0.5
        z = (F.log(a / (inside + 1.0)) - F.log(b / (outside + 1.0))) / F.sqrt(1 / a + 1 / b)
        own = a / (inside + 1.0)
        strong = own / (own + b / (outside + 1.0)) >= STRONG
        for which in (strong, ~strong):
            top = per.where(F.col(f"d{i}") >= CUE_LEAST).where(which).withColumn("z", z).where(F.col("z") > CUE_Z).orderBy(F.desc("z"), "stem").limit(CUES).collect() if inside and outside else []
            out.append([x.stem for x in top])
    return out


def features(text: Column, spoken: list[list[str]]) -> Column:
    """n_words, and an array of the bins of all features."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n, chars = F.size(w), F.greatest(F.length(t), F.lit(1))
        marks = F.length(t) - F.length(F.translate(t, "#*$%&|<>!", ""))
        capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        repeated = n - F.size(F.array_distinct(w))
        bins = [_log_bin(n, 8.0), _log_bin(marks / chars, 0.002), _log_bin(capitals / chars, 0.002), _log_bin(repeated / F.greatest(n, F.lit(1)), 0.02), _log_bin(chars / F.greatest(n, F.lit(1)), 0.5)]
        heard = lambda own: F.array(*(F.least(F.lit(BINS - 1), F.size(F.array_intersect(own, F.array(*map(F.lit, stems))))) if stems else F.lit(0) for stems in spoken))
        return F.struct(n.cast("bigint").alias("n_words"), F.concat(F.array(*bins), let(_stems(w), heard)).alias("bins"))

    return let(pieces(t, BLANK), of)


def classifier(rows: DataFrame, labelled: DataFrame, names: list[str]) -> Column:
    """The posterior of each domain as an expression over bins: naive Bayes on the labelled among rows (doc_id, bins)."""
    seen = rows.where("doc_id IS NOT NULL").select("doc_id", "bins").join(labelled, "doc_id").select("domain", F.posexplode("bins").alias("f", "bin"))
    counts = {(x.domain, x.f, x.bin): x["count"] for x in seen.groupBy("domain", "f", "bin").count().collect()}  # domains by features by bins
    n = {d: sum(v for (y, f, _), v in counts.items() if y == d and f == 0) for d in names}
    total = [F.lit(math.log((n[d] + 1) / (sum(n.values()) + len(names)))) for d in names]
    for f in range(SHAPES + 2 * len(names)):
        for i, d in enumerate(names):
            logs = [math.log((counts.get((d, f, b), 0) + 0.5) / (n[d] + 0.5 * BINS)) for b in range(BINS)]
            total[i] = total[i] + F.element_at(F.array(*map(F.lit, logs)), F.col("bins")[f] + 1)
    odds = lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    share = lambda e: F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 6))
    return let(let(F.array(*total), odds), share)


def fit(groups: DataFrame, targets: list[float], budget: float) -> DataFrame:
    """groups (p and tokens) with their rates. targets are shares of budget times all tokens.

    Each step moves the rates against the gradient and projects them to 0 or more; every few steps they are written, so
    that a step does not go through all before it.
    """
    k = len(targets)
    mass = lambda: [F.coalesce(F.sum(F.col("rate") * F.col("p")[i] * F.col("tokens")), F.lit(0.0)).alias(f"m{i}") for i in range(k)]
    groups = groups.withColumn("rate", F.lit(1.0))
    first = groups.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), *mass()).first()
    total = float(first.t) or 1.0
    weight = [1 / max(1e-2, first[f"m{i}"] / total) for i in range(k)]  # residuals count in proportion to the domain
    before, size = None, 1 / (1 + PULL)
    for step in range(STEPS):
        now = groups.agg(*mass()).first()
        slope = [(now[f"m{i}"] / total - budget * targets[i]) * weight[i] for i in range(k)]
        if before and max(abs(a - b) for a, b in zip(slope, before, strict=True)) < TOLERANCE:
            break
        before = slope
        along = sum((F.col("p")[i] * g for i, g in enumerate(slope)), F.lit(0.0))
        groups = groups.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - size * (along + PULL * (F.col("rate") - 1))))
        if step % STEPS_HELD == STEPS_HELD - 1:
            groups = keep(groups, "rates")
    return keep(groups, "rates")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """Rates that bring the expected tokens of each domain to targets (shares of budget times all tokens).

    labelled: doc_id and domain. Returns the columns of docs but text, then n_words, p (posteriors in the order of targets), rate
    and copies (rate rounded up or down by a hash of doc_id, so that its mean is the rate). Columns of docs with those
    names are replaced. A null or empty text has no tokens and the posterior of such texts. Rows with the same doc_id get
    the same rounding. Without labels all domains are equally likely. Targets that cannot be met are met as nearly as
    least squares can. An empty table gives an empty result.
    """
    names = list(targets)
    docs = docs.select(*(c for c in docs.columns if c not in ("n_words", "p", "bins", "rate", "copies", "_f")))
    labelled = keep(labelled.where(F.col("domain").isin(names)), "labelled")
    spoken = cues(docs, labelled, names)
    # every column but the text, so that the text is read once
    light = keep(docs.withColumn("_f", features(F.col("text"), spoken)).select(*(c for c in docs.columns if c != "text"), "_f.*"), "features")
    light = keep(light.withColumn("p", classifier(light, labelled, names)).drop("bins"), "posteriors")
    groups = keep(light.groupBy("p").agg(F.sum("n_words").alias("tokens")), "posterior-groups")
    rates = fit(groups, [targets[d] for d in names], budget).select("p", F.round("rate", 9).alias("rate"))
    part = F.pmod(F.xxhash64(F.lit("copies"), id_or_last(F.col("doc_id"))), F.lit(1_000_000)) / 1_000_000
    out = light.join(small(rates, rates.count(), SMALL_ROWS), "p").select(*light.columns, "rate")
    return out.withColumn("copies", (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text"), domains(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(TARGETS)), "rate", "copies")
