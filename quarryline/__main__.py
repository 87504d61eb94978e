"""Command line: ``python -m quarryline VERB ROOT [TEXT]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quarryline.operators import rules
from quarryline.plans import sinks, verbs
from quarryline.plans.index import build_index, load
from quarryline.sources import files as sources
from quarryline.sources.history import git_history

ON_FILES = {"security": verbs.security, "api": verbs.api, "deps": verbs.deps, "benchmark": verbs.benchmark}
ON_INDEX = {"clone": verbs.clones, "hotspots": verbs.hotspots, "scope": verbs.scope}
WITH_TEXT = {"search": verbs.search, "trace": verbs.trace, "ask": verbs.context, "coupled": verbs.coupled}


def run(spark: SparkSession, args: argparse.Namespace) -> list[DataFrame]:
    if args.verb == "index":
        tree = sources.scan(spark, args.root)
        build_index(tree, git_history(spark, args.root).select("commit_id", "file_path")).save(args.index)
        return []
    if args.verb in ON_FILES or args.verb == "grep":
        held = sources.security_files(sources.read_tree(spark, args.root))
        return [verbs.grep(held, args.text)] if args.verb == "grep" else [ON_FILES[args.verb](held)]
    index = load(spark, args.index)
    index.contents = sources.scan(spark, args.root)
    if args.verb in WITH_TEXT:
        return [WITH_TEXT[args.verb](index, args.text)]
    if args.verb in ON_INDEX:
        return [ON_INDEX[args.verb](index)]
    if args.verb == "doctor":
        return list(verbs.doctor(index, severity=args.severity))
    if args.verb == "map":
        return [verbs.code_map(index, args.format if args.format in ("mermaid", "dot") else "mermaid", args.depth).orderBy("section", "seq").select("line")]
    if args.verb == "dead":
        return list(verbs.dead(index).values())
    if args.verb == "test-gap":
        return list(verbs.test_gap(index))
    if args.verb == "diff":
        return list(verbs.diff(index, sources.git_changed(spark, args.root)))
    return list(verbs.stats(index).values()) if args.verb == "stats" else list(verbs.explain(index))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarryline")
    p.add_argument("verb", choices=sorted(["index", "grep", "doctor", "map", "dead", "test-gap", "diff", "stats", "explain", *ON_FILES, *ON_INDEX, *WITH_TEXT]))
    p.add_argument("root")
    p.add_argument("text", nargs="?", default="")
    p.add_argument("--index", default="quarryline-index", help="folder of the index tables")
    p.add_argument("--format", default="table", choices=["table", "json", "csv", "sarif", "html", "mermaid", "dot"])
    p.add_argument("--output", help="folder or file to write to")
    p.add_argument("--severity")
    p.add_argument("--fail-on", help="exit 1 if a finding reaches this severity")
    p.add_argument("--depth", type=int)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("quarryline").getOrCreate()
    told = run(spark, args)
    for k, df in enumerate(told):
        if args.format == "sarif" and args.verb == "security":
            df = sinks.sarif(df).withColumnRenamed("document", "value")
        if args.format == "html" and args.verb == "security":
            text = sinks.html_report(df)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
        elif args.output:
            sinks.write(df, f"{args.output}/{k}" if len(told) > 1 else args.output, {"json": "json", "csv": "csv", "sarif": "text"}.get(args.format, "json"))
        else:
            df.show(50, False)
    return int(bool(args.fail_on and args.verb == "security" and rules.gate(told[0], args.fail_on)))


if __name__ == "__main__":
    sys.exit(main())
