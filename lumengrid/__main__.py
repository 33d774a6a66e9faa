"""python -m lumengrid OPTIONS: node files of every redshift to grids. python -m lumengrid merge BASE OUT NC NODES: node grids to global ones."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lumengrid.config import parse
from lumengrid.plans import run


def main(args: list[str]) -> None:
    spark = SparkSession.builder.appName("lumengrid").getOrCreate()
    if args[:1] == ["merge"]:
        base, out, nc, nodes = args[1:5]
        print(run.merge(spark, base, out, int(nc), int(nodes)))
        return
    written, report = run.run(spark, parse(args))
    print(*written, sep="\n")
    report.table(spark).orderBy("redshift", "phase").show(1000, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
