"""Command line: ``python -m knotwork solve`` for one set of a whole graph, ``python -m knotwork batch`` for queries around seeds."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from knotwork.operators import community, solvers
from knotwork.sources import edges as io


def arguments() -> argparse.ArgumentParser:
    """The options of both commands."""
    parser = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    solve = commands.add_parser("solve", help="largest set of a graph")
    solve.add_argument("--algo", choices=[*solvers.ALGORITHMS, "se", "naive"], default="ebac")
    solve.add_argument("--file", required=True, help="edge list")
    solve.add_argument("--tau", type=float, default=0.9)
    solve.add_argument("--out", help="folder for the key=value report")
    batch = commands.add_parser("batch", help="largest sets around the seeds of a query list")
    batch.add_argument("--file", required=True, help="edge list")
    batch.add_argument("--queries", required=True, help="lines of: seed model param [id,id,...]")
    batch.add_argument("--out", required=True, help="folder for a line per query")
    batch.add_argument("--hops", type=int, default=2)
    batch.add_argument("--cap", type=int, default=3000)
    batch.add_argument("--timeout", type=float, default=5.0)
    return parser


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; prints the report, or how many queries were answered and how many passed over."""
    args = arguments().parse_args(given)
    spark = spark or SparkSession.builder.appName("knotwork").getOrCreate()
    edges = io.read_edges(spark, args.file)
    if args.command == "solve":
        result = solvers.max_subgraph(edges, args.tau, args.algo)
        print("\n".join(r["value"] for r in io.human_report(result).collect()))  # one result
        if args.out:
            io.write_report(result, args.out)
        return 0
    asked = io.read_queries(spark, args.queries)
    good = asked.where("ok").select(F.col("line").alias("query_id"), "seed", "model", "param", "restrict")
    found = io.saved_results(community.community_search(edges, good, args.hops, args.cap, max(args.timeout, 1e-3)))
    io.write_results(found, args.out)
    done, missing = community.batch_counts(found).first()
    print(f"processed={done} skipped={missing + asked.where('not ok').count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
