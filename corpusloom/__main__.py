"""Command line: ``python -m corpusloom QUERY FOLDER [--out PATH]``, ``--list``, or ``--eval [--markdown]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description="Run a query over a folder of tables.")
    out.add_argument("query", nargs="?", help="the name of a query")
    out.add_argument("folder", nargs="?", help="the folder of the Parquet tables")
    out.add_argument("--out", help="write the result to this path as Parquet instead of showing it")
    out.add_argument("--rows", type=int, default=20, help="rows to show")
    out.add_argument("--list", action="store_true", help="list the queries")
    out.add_argument("--eval", action="store_true", help="evaluate the fixture corpus")
    out.add_argument("--markdown", action="store_true", help="the evaluation's report as Markdown")
    out.add_argument("--strict", action="store_true", help="fail below 100 percent")
    return out


def main(arguments: list[str] | None = None) -> int:
    from corpusloom import evaluation
    from corpusloom.operators import answer
    from corpusloom.plans import registry
    from corpusloom.session import ship_package

    options = parser().parse_args(arguments)
    if options.list:
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    if options.eval:
        outcomes = evaluation.evaluate(*evaluation.seed(spark))
        print(evaluation.report(outcomes, markdown=options.markdown))
        scores = answer.metrics(outcomes).first()
        low = any(scores[c] < 1 for c in ("hit_rate", "mode_correct", "citations_valid"))
        return 1 if options.strict and low else 0
    if options.query not in registry.queries() or not options.folder:
        print("name a query and a folder; --list shows the queries", file=sys.stderr)
        return 2
    found = registry.queries()[options.query](spark, options.folder)
    if options.out:
        found.write.mode("overwrite").parquet(options.out)
    else:
        found.show(options.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
