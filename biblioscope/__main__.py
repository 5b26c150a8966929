"""Command line: compute named results and write them.

    python -m biblioscope list
    python -m biblioscope explain NAME (--testdata SF_DIR | --articles P ...)
    python -m biblioscope run NAME [NAME ...] --out DIR
        (--testdata SF_DIR | --articles P --journaux P --authors-labs P [--format jsonl|json|parquet])
        [--documents P] [--write-format parquet|json|csv] [--refresh] [--buckets N]

Each result is written to ``DIR/NAME`` by Spark; nothing passes through the
driver.  On a cluster, submit with ``spark-submit -m biblioscope`` settings of
the cluster; the cleaned tables go under its ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import sys

from biblioscope.plans.catalog import RESULTS
from biblioscope.session import build_session
from biblioscope.sources.tables import Workspace


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="biblioscope")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("--out", required=True)
    run.add_argument("--write-format", default="parquet", choices=["parquet", "json", "csv"])
    explain = sub.add_parser("explain")
    for cmd in (run, explain):
        cmd.add_argument("names", nargs="+")
        cmd.add_argument("--testdata")
        cmd.add_argument("--articles")
        cmd.add_argument("--journaux")
        cmd.add_argument("--authors-labs")
        cmd.add_argument("--documents")
        cmd.add_argument("--format", default="jsonl", choices=["jsonl", "json", "parquet"])
        cmd.add_argument("--master")
        cmd.add_argument("--buckets", type=int, help="keep articles and labs bucketed by doi and lab as well")
        cmd.add_argument("--refresh", action="store_true",
                         help="rebuild landed and cleaned tables even if a committed copy exists")
    args = p.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(RESULTS))
        return 0
    unknown = [n for n in args.names if n not in RESULTS]
    if unknown:
        p.error(f"unknown results {unknown}; see 'list'")
    spark = build_session(args.master)
    if args.testdata:
        ws = Workspace.from_testdata(spark, args.testdata, refresh=args.refresh, buckets=args.buckets)
    else:
        paths = {"articles": args.articles, "journaux": args.journaux,
                 "authors_labs": args.authors_labs}
        if not all(paths.values()):
            p.error("give --testdata or all of --articles --journaux --authors-labs")
        ws = Workspace.from_landing(spark, paths, args.format, documents_path=args.documents,
                                    refresh=args.refresh, buckets=args.buckets)
    if args.cmd == "explain":
        for name in args.names:
            print(f"== {name} ==")
            RESULTS[name](ws).explain("formatted")
        return 0
    for name in args.names:
        df = RESULTS[name](ws)
        writer = df.write.mode("overwrite")
        if args.write_format == "csv":
            writer = writer.option("header", "true")
        getattr(writer, args.write_format)(f"{args.out.rstrip('/')}/{name}")
        print(f"wrote {name}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
