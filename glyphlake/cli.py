"""inspect and validate from a shell: exit codes 0 in order, 1 unreadable, 2 format error, 3 issues."""

from __future__ import annotations

import argparse
import os
import sys

import glyphlake


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser("glyphlake", exit_on_error=False)
    parser.add_argument("-V", "--version", action="version", version=glyphlake.__version__)
    commands = parser.add_subparsers(dest="command")
    for name in ("inspect", "validate"):
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        if isinstance(e, SystemExit) and e.code in (0, None):
            return 0
        print(f"glyphlake: {e}", file=sys.stderr)
        return 2
    if args.command is None:
        parser.print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession, functions as F

    from glyphlake.operators import rules, structure
    from glyphlake.sources import files, sinks

    spark = spark or SparkSession.builder.appName("glyphlake").getOrCreate()
    if not os.path.isfile(args.file):
        missing = spark.createDataFrame([(args.file,)], "path string")
        print(sinks.error_json(missing, 2).first()["json"] if args.json or args.command == "validate" else f"glyphlake: can't read {args.file}")
        return 1
    found = files.read_files(spark, args.file).withColumn("path", F.lit(args.file))
    families = "structure" if args.command == "inspect" else "structure integrity semantics resources decode"
    checked = rules.validate(structure.index_files(found), families=families).cache()
    report = sinks.validate_json(checked) if args.command == "validate" else sinks.inspect_json(checked) if args.json else sinks.chunk_tree(checked)
    print(report.first()[1])
    return checked.select(rules.exit_code().alias("code")).first()["code"]


if __name__ == "__main__":
    sys.exit(main())
