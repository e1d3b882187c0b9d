"""Command line: add data, analyse, train, validate, update, clear."""

from __future__ import annotations

import argparse
import json
import logging


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymill")
    p.add_argument("--config", default="config.yaml")
    p.add_argument("--mode", choices=("add_data", "analyse", "train", "update", "val"))
    p.add_argument("--path-csv")
    p.add_argument("--date-until")
    p.add_argument("--old", help="bundle to start from")
    p.add_argument("--new", help="family to train (tree, mlp, auto)")
    p.add_argument("--bundle", default="model", help="where a new bundle goes")
    p.add_argument("--sweep", nargs="*", default=[])
    p.add_argument("--profile", help="folder for time and memory pages of the run")
    p.add_argument("--clear", action="store_true")
    p.add_argument("--drift-ref", action="store_true")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Reject combinations that make no sense."""
    if args.clear and (args.mode or args.drift_ref):
        raise SystemExit("--clear goes alone")
    if args.drift_ref and args.mode:
        raise SystemExit("--drift-ref goes without --mode")
    if not (args.clear or args.drift_ref or args.mode):
        raise SystemExit("name a --mode, --clear or --drift-ref")
    if args.mode == "add_data" and not args.path_csv:
        raise SystemExit("add_data needs --path-csv")
    if args.mode in ("train", "val", "update") and bool(args.path_csv) == bool(args.date_until):
        raise SystemExit("give exactly one of --path-csv and --date-until")
    if args.mode == "train" and bool(args.new) == bool(args.old):
        raise SystemExit("train needs exactly one of --new and --old")
    if args.mode in ("val", "update") and not args.old:
        raise SystemExit(f"{args.mode} needs --old")
    return args


def main(argv: list[str] | None = None) -> int:
    args = checked(parser().parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    from tallymill.config import load_config
    from tallymill.plans import lifecycle as life

    spark = SparkSession.builder.appName("tallymill").getOrCreate()
    config = load_config(args.config)

    def run():
        if args.clear:
            return life.clear(spark, config)
        if args.drift_ref:
            return life.build_reference(spark, config)
        if args.mode == "add_data":
            return life.add_data(spark, config, [args.path_csv])
        life.ensure_data(spark, config)
        if args.mode == "analyse":
            return life.refresh_quality(spark, config)
        if args.mode == "train" and args.new:
            return life.train(spark, config, args.new, args.bundle, args.path_csv, args.date_until, args.sweep)
        if args.mode in ("train", "update"):
            return life.update(spark, config, args.old, args.bundle, args.path_csv, args.date_until)
        return life.validate(spark, config, args.old, args.path_csv, args.date_until)

    if args.profile:
        from tallymill.operators.monitor import profiled

        out, _ = profiled(run, args.profile, args.mode or "clear", spark)
    else:
        out = run()
    print(json.dumps(out, default=str, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
