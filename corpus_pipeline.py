"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing, each stage written and read again.

Every stage works row by row of the table before it. Null and empty texts count as empty. Rows with one doc_id are rows of
their own: each stays or goes by its own text (with a null doc_id too), but labels are looked up by doc_id, so a label
holds for all rows with its id. Columns beyond those of documents are left out. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import decontaminate, line_dedup, mixing, near_copies, quality
from lumengrid.llm.common import keep, table
from lumengrid.session import made, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents below this quality score are rejected.
LEAST_QUALITY = 0.5
#: Tokens to read, as a multiple of those that there are: above 1, so that clean documents are read at least once.
BUDGET = 1.25


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. A null or empty text has the score of its only feature, the bias."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).where(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; n_chars follows the text. All documents stay; a null text becomes an empty one."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that shares 0.8 of its five-word pieces: the smallest doc_id, null last.

    Of rows with one doc_id each stays or goes by its own text; equal rows are copies, and one of them stays. Blank texts
    are one group.
    """
    return near_copies.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, row by row. Items without words drop nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of the documents that the mix reads. A document without words has no tokens to weigh; it keeps its rate."""
    mixed = mixing.mix(docs, mixing.domains(table(spark, sf_dir, "labels")), budget=BUDGET)
    return mixed.where("copies > 0").select("doc_id", "lang", "source", "n_chars", "n_words", "rate", "copies")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: A trained classifier and an iterative fit are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark, but=1)  # all but the stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
