"""``python -m pathlens SNAPSHOT QUERY``: searches a snapshot; ``--scan ROOT`` makes one first."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pathlens.operators.search import search
from pathlens.sources.fsscan import scan
from pathlens.sources.snapshots import Snapshots


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pathlens", description=__doc__)
    p.add_argument("snapshot")
    p.add_argument("query")
    p.add_argument("--scan", action="append", default=[], metavar="ROOT")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--mode", default="exact")
    p.add_argument("--sort")
    p.add_argument("--order")
    p.add_argument("--root", help="only paths at or below this one")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("pathlens").getOrCreate()
    shots = Snapshots(spark, a.snapshot)
    if a.scan:
        shots.rebuild(lambda: scan(spark, a.scan))
    files = shots.current()
    if files is None:
        p.error("there is no snapshot yet; use --scan")
    if a.root:
        from pathlens.functions.paths import is_under
        from pyspark.sql import functions as F

        files = files.where(is_under(F.col("path"), a.root))
    for row in search(files, a.query, a.limit, a.mode, a.sort, a.order).toLocalIterator():
        print(row.path, row.size, row.score, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
