"""Command line: build, query, remove, info."""

from __future__ import annotations

import argparse
import sys

from kscreen.functions import params


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kscreen")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="build filters from references")
    b.add_argument("-r", "--reference")
    b.add_argument("-l", "--list", help="a text file of references, one a line")
    b.add_argument("-o", "--output", help="the filter's path; with a list, a folder")
    b.add_argument("-k", "--kmer", type=int, default=0)
    b.add_argument("-e", "--error-rate", type=float, default=params.CLI_ERROR_RATE)
    for name in ("query", "remove"):
        q = sub.add_parser(name)
        q.add_argument("-r", "--filter", help="a filter, a folder of filters or a list; by default the settings' folder")
        q.add_argument("-q", "--query", required=True)
        q.add_argument("-t", "--threshold", type=float, default=0.0)
        q.add_argument("-o", "--output", help="for remove: a folder, which gets one folder a filter; without it records are printed")
        q.add_argument("-x", "--exact", action="store_true")
        if name == "query":
            q.add_argument("-f", "--format", choices=("json", "tsv"), default="json")
            q.add_argument("-s", "--sampling-rate", type=float, default=1.0)
    sub.add_parser("info").add_argument("filter")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from kscreen.operators.report import tsv
    from kscreen.plans import screen
    from kscreen.sources import fastx, filters, tables
    from kscreen.sources.config import settings

    own = settings()
    if a.command in ("query", "remove") and not (a.filter or own.get("filters")):
        parser().error("no filter is named, here or in the settings")
    spark = SparkSession.builder.appName("kscreen").getOrCreate()
    if a.command == "build":
        sources = [r[0] for r in spark.read.text(a.list).filter("trim(value) <> ''").collect()] if a.list else [a.reference]
        if a.list:
            print("\n".join(screen.build_list(spark, sources, a.output, a.kmer, a.error_rate)))
        else:
            print(screen.build(spark, a.reference, a.output, a.kmer, a.error_rate))
    elif a.command == "query":
        for f in filters.listed(spark, a.filter or own["filters"]):
            doc = screen.query(spark, a.query, f, a.threshold, a.sampling_rate, a.exact)
            if own.get("store"):
                tables.write_json(doc, own["store"])
            if a.format == "json":
                print(doc.toJSON().first())
            else:
                rows = tsv(doc)
                print("\t".join(rows.columns), "\t".join(map(str, rows.first())), sep="\n")
    elif a.command == "remove":
        found = filters.listed(spark, a.filter or own["filters"])
        if a.output:
            print("\n".join(screen.remove_many(spark, a.query, found, a.output, a.threshold, a.exact)))
        else:  # clean records to the standard output, contaminated ones to the standard error
            for f in found:
                fastx.print_split(screen.classified(spark, a.query, f, a.threshold, exact=a.exact), sys.stdout, sys.stderr)
    else:
        screen.info(spark, a.filter).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
