"""python -m treegauge FOLDER... [--out FOLDER]: audits local trees, prints a report of each, and stores their documents."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treegauge.plans import results
from treegauge.sources import landed


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ask = argparse.ArgumentParser(prog="treegauge", description=__doc__)
    ask.add_argument("folders", nargs="+", help="trees to audit, one repository each")
    ask.add_argument("--out", help="where documents are stored, one an id")
    ask.add_argument("--as-meant", action="store_true", help="audit as the rules mean instead of as they behave")
    given = ask.parse_args(argv)
    missing = [f for f in given.folders if not Path(f).is_dir()]
    if missing:
        print(f"no folder: {', '.join(missing)}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("treegauge").getOrCreate()
    roots = {Path(f).resolve().name: str(Path(f).resolve()) for f in given.folders}
    tell = lambda stage, percent, message: print(f"{percent:3}% {stage}: {message}", file=sys.stderr)
    documents = results.of_folders(spark, roots, datetime.now(UTC).replace(tzinfo=None), fixed=given.as_meant, progress=tell)
    if given.out:
        landed.save_results(documents, given.out)
    r = documents.select(F.from_json("document", landed.RESULT).alias("r")).select("r.id", "r.scores.overall", "r.scores.grade", F.size("r.findings").alias("n"), F.slice("r.plan", 1, 5).alias("plan"))
    for x in r.orderBy("id").toLocalIterator():  # a row a repository asked for
        print(f"{x.id}: {x.overall}/100 (grade {x.grade}), {x.n} findings")
        for p in x.plan:
            print(f"  {p.rank}. [{p.impact}/{p.effort}] {p.title}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
