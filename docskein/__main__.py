"""``spark-submit`` entry: files of text to a graph.

    python -m docskein INPUT --metamodel FILE --provider package.module:name [--output-dir DIR]

INPUT is a folder or file of .txt pages (form feeds between pages) or .pdf.  The
provider is an object with ``attach``.  Exit code 0 if a summary was written.
"""

from __future__ import annotations

import argparse
import importlib
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docskein", description="files to a knowledge graph")
    p.add_argument("input")
    p.add_argument("--metamodel", required=True)
    p.add_argument("--provider", required=True, help="package.module:name of an object with attach()")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--suffix", default=".txt", choices=[".txt", ".pdf"])
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from docskein.plans.build import build_graph
    from docskein.sources.metamodel import read_metamodel
    from docskein.sources.pages import form_feed_pages, pdf_pages, read_pages
    from docskein.sources.stages import Stages

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("docskein").getOrCreate()
    module, _, name = args.provider.partition(":")
    try:
        pages, errors = read_pages(spark, args.input, pdf_pages if args.suffix == ".pdf" else form_feed_pages, suffix=args.suffix)
    except Exception as e:  # a path that is not there
        print(f"cannot read {args.input}: {e}", file=sys.stderr)
        return 1
    classes, properties = read_metamodel(spark, args.metamodel)
    stages = Stages(spark, f"{args.output_dir}/stages")
    pages = stages.keep("pages", pages)
    graph = build_graph(pages, classes, properties, getattr(importlib.import_module(module), name), stages=stages)
    graph.errors = graph.errors.unionByName(errors)
    graph.write(args.output_dir)
    told = graph.summary.first()
    print(f"{told['files']} files, {told['classes']} classes, {told['properties']} properties")
    return 0 if told else 1


if __name__ == "__main__":
    sys.exit(main())
