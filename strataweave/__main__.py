"""Command line: ``python -m strataweave inspect|analyze|merge|verify``.

Archives in, a plan (JSON) or a merged archive out. Choices are ``conflict=variant``
pairs or an input that decides whatever is left.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataweave.plans import archives, resolve
from strataweave.plans.engine import MergeError
from strataweave.plans.rules import Profile, read_profiles
from strataweave.sources import archive


def _inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    archive.register(spark)
    found = spark.read.format("overlay_archive").load(args.archive)
    found.select("path", "method", "stored", "logical", "sha256").orderBy("path").show(args.rows, truncate=False)
    found.groupBy("archive", "version", "mount").agg(F.count("*").alias("entries"), F.sum("logical").alias("bytes")).show(64, truncate=False)


def _profiles(spark: SparkSession, args: argparse.Namespace) -> list[Profile]:
    return read_profiles(spark, args.profiles) if args.profiles else []


def _analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    made = archives.analyze_archives(spark, args.inputs, _profiles(spark, args))
    head = spark.createDataFrame([(made.plan_id, list(made.input_ids))], "plan_id string, inputs array<string>")
    head.write.mode("errorifexists").json(f"{args.out}/plan")
    made.conflicts.write.mode("errorifexists").json(f"{args.out}/conflicts")
    made.actions.select("group_key", "n_providers", "action").write.mode("errorifexists").json(f"{args.out}/actions")
    print(json.dumps({"plan_id": made.plan_id, "inputs": made.input_ids, "conflicts": made.conflicts.count(), "warnings": [r.warning for r in made.warnings.limit(100).collect()]}))


def _merge(spark: SparkSession, args: argparse.Namespace) -> None:
    made = archives.analyze_archives(spark, args.inputs, _profiles(spark, args))
    pairs = resolve.inline_choices(args.choose)
    choices = spark.createDataFrame(list(pairs.items()), "conflict_id string, variant_id string")
    if args.prefer is not None:
        wanted = made.input_ids[args.prefer]
        choices = choices.union(resolve.bulk_choose(made.conflicts, made.variants, choices, wanted))
        choices = choices.union(resolve.bulk_choose(made.conflicts, made.variants, choices, made.input_ids[0]))
    back = archives.merge_archives(made, choices, args.out, args.name, plan_id=args.plan_id)
    print(json.dumps({"plan_id": made.plan_id, "entries": back.count()}))


def _verify(spark: SparkSession, args: argparse.Namespace) -> None:
    archive.register(spark)
    found = spark.read.format("overlay_archive").load(args.archive)  # strict: raises on any damage
    print(json.dumps({"entries": found.count(), "sound": found.where("not sha1_ok").count() == 0}))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataweave", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, run, build in (
        ("inspect", _inspect, lambda p: (p.add_argument("archive"), p.add_argument("--rows", type=int, default=100))),
        ("verify", _verify, lambda p: p.add_argument("archive")),
        ("analyze", _analyze, lambda p: (p.add_argument("inputs", nargs="+"), p.add_argument("--out", required=True), p.add_argument("--profiles"))),
        (
            "merge",
            _merge,
            lambda p: (
                p.add_argument("inputs", nargs="+"),
                p.add_argument("--out", required=True),
                p.add_argument("--name", default="merged_P.pak"),
                p.add_argument("--plan-id", default=""),
                p.add_argument("--choose", nargs="*", default=[]),
                p.add_argument("--prefer", type=int),
                p.add_argument("--profiles"),
            ),
        ),
    ):
        command = commands.add_parser(name)
        build(command)
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strataweave").getOrCreate()
    try:
        args.run(spark, args)
    except (MergeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
