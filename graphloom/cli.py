"""Command line: ``python -m graphloom.cli run CONFIG.json`` and ``... query NAME SF_DIR``."""

from __future__ import annotations

import argparse
import sys


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="draft, repair and score the domains of a configuration")
    r.add_argument("config")
    r.add_argument("--requirements")
    r.add_argument("--limit", type=int)
    r.add_argument("--policies", help="comma-separated; the configuration's where it is not given")
    r.add_argument("--max-iterations", dest="max_iterations", type=int)
    r.add_argument("--threshold", type=float)
    r.add_argument("--draft-only", dest="draft_only", action="store_true", default=None)
    r.add_argument("--output")
    for name in ("base", "shapes", "questions", "gold", "vocabulary", "base-graph", "generator", "prefix"):
        r.add_argument(f"--{name}", dest=name.replace("-", "_"), help="instead of the configuration's")
    for name in ("batch-size", "min-patch-iterations"):
        r.add_argument(f"--{name}", dest=name.replace("-", "_"), type=int)
    r.add_argument("--no-reason", dest="reason", action="store_false", default=None, help="without inference")
    q = sub.add_parser("query", help="run one registered query and show rows of it")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("--rows", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    from pyspark.sql import SparkSession

    from graphloom.common import release, ship

    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if a.command == "query":
        from graphloom.queries_data import QUERIES as data
        from graphloom.queries_graph import QUERIES as graph

        known = data | graph
        if a.name not in known:
            print(f"unknown query {a.name}", file=sys.stderr)
            return 2
        known[a.name](spark, a.sf_dir).show(a.rows, False)
        return 0
    from graphloom.plans import pipeline

    given = {k: v for k, v in vars(a).items() if k not in ("command", "config", "threshold")}
    configs = pipeline.load_config(a.config, thresholds=[a.threshold] if a.threshold is not None else None, **given)
    for c in configs:
        tables = pipeline.run(spark, c)
        for name, df in tables.items():
            if name.endswith(("_log", "exact", "semantic", "reasoner")):
                print(f"{c.name}: {name}")
                df.show(truncate=False)
        print("\n".join(f"{c.name}: {line}" for line in pipeline.summary(tables)))
        release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
