"""python -m scatterlake run|status|verify|prep|describe: the command surface."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scatterlake")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run stages over a store")
    run.add_argument("config", help="JSON or YAML text, or a file that holds it")
    run.add_argument("--source", help="folder with points, phase and dates tables, for stage 1")
    status = sub.add_parser("status", help="the last complete stage")
    status.add_argument("root")
    check = sub.add_parser("verify", help="compare two tables of long rows within tolerances")
    check.add_argument("run_path")
    check.add_argument("golden_path")
    check.add_argument("--rtol", type=float, default=1e-5)
    check.add_argument("--atol", type=float, default=1e-7)
    prep = sub.add_parser("prep", help="raster stack to candidates")
    prep.add_argument("root")
    prep.add_argument("out")
    prep.add_argument("--width", type=int, required=True)
    prep.add_argument("--patches", type=int, nargs=2, default=(1, 1))
    prep.add_argument("--overlap", type=int, default=50)
    sub.add_parser("describe", help="kernels and queries")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("scatterlake").getOrCreate()
    from scatterlake.operators import verify
    from scatterlake.plans import catalog, pipeline, registry
    from scatterlake.plans.config import RunConfig
    from scatterlake.plans.store import Store
    from scatterlake.sources import stack

    if args.command == "run":
        text = args.config if args.config.lstrip().startswith("{") else "\n".join(r["value"] for r in spark.read.text(args.config).collect())
        config = RunConfig.parse(text)
        source = {n: spark.read.parquet(f"{args.source}/{n}") for n in ("points", "phase", "dates")} if args.source else {}
        log = pipeline.run(Store(spark, config.root), config, source).collect()
        for r in log:
            print(json.dumps(r.asDict()))
        return int(any(r["status"] == "failed" for r in log))
    if args.command == "status":
        print(Store(spark, args.root).status())
    elif args.command == "verify":
        policies = verify.Policies(verify.Policy(args.rtol, args.atol)).table(spark)
        report = verify.compared(spark.read.parquet(args.run_path), spark.read.parquet(args.golden_path), policies)
        failed = report.where(~F.col("passed")).count()
        report.show(200, truncate=False)
        return int(failed > 0)
    elif args.command == "prep":
        stack.prepare(spark, args.root, args.width, *args.patches, args.overlap).write.mode("overwrite").partitionBy("patch_id").parquet(args.out)
    else:
        print(json.dumps({"kernels": registry.default_kernels().describe(), "queries": sorted(catalog.QUERIES)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
