"""Fields of snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def field_stream(spark: SparkSession, path: str, schema: str, field: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that computes field for the rows of each redshift in every batch of new parquet files, and appends the result to out.

    schema must have a redshift column; files of a redshift are expected together. Batches are written with their number,
    so that a repeated batch replaces itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for x in rows.select("redshift").distinct().toLocalIterator():  # a few values
                part = rows.where(rows.redshift == x.redshift).drop("redshift")
                field(part).write.mode("overwrite").parquet(f"{out}/redshift={x.redshift}/batch={number}")
        finally:
            rows.unpersist()

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_stream(spark: SparkSession, base: str, redshifts: str, order: str = "<") -> DataFrame:
    """A stream of the rows of xv snapshots with their redshift, as lines are added to a list of redshifts.

    Files of a redshift must be whole before its line is. A query that starts again from its checkpoint goes on after the
    lines that it has finished.
    """
    from lumengrid.sources.binary import SnapshotStreamSource

    spark.dataSource.register(SnapshotStreamSource)
    return spark.readStream.format(SnapshotStreamSource.name()).options(base=base, redshifts=redshifts, order=order).load()
