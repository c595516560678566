"""Command line: python -m tidefold filter|simulate|models."""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

from tidefold.errors import ParamError, TidefoldError
from tidefold.operators import sigma
from tidefold.operators.kernels import METHODS, RESAMPLERS
from tidefold.operators.simulate import simulate, wide
from tidefold.plans import models
from tidefold.runs import Run, RunOptions
from tidefold.sources.files import default_name, text_table, write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidefold")
    p.add_argument("--verbose", type=int, choices=(0, 1, 2), default=0)
    p.add_argument("--config", help="TOML file of option values; the command line goes first")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("models", help="list the models")
    for name in ("filter", "simulate"):
        c = sub.add_parser(name)
        c.add_argument("--model", required=True)
        c.add_argument("--steps", type=int)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--series", type=int, default=1)
        c.add_argument("--out")
        c.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="parameter of the model")
        if name == "filter":
            c.add_argument("--method", required=True, choices=sorted(METHODS))
            c.add_argument("--data", help="file of X and Y columns")
            c.add_argument("--sigma-set", choices=sigma.names(), default="wan2000")
            c.add_argument("--particles", type=int, default=300)
            c.add_argument("--resampling", choices=RESAMPLERS, default="stratified")
            c.add_argument("--latex", action="store_true", help="scores as a LaTeX table")
        else:
            c.add_argument("--without-x", action="store_true")
    return p


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    if args.command == "models":
        for kind in ("linear", "nonlinear"):
            print(f"{kind}:", *models.names(kind), sep="\n  ")
        return 0
    if args.command == "filter" and (args.steps is None) == (args.data is None):
        raise ParamError("give either --steps or --data")
    given = dict(p.split("=", 1) for p in args.param if "=" in p)
    model = models.create(args.model, **{k: float(v) for k, v in given.items()})
    if args.command == "simulate":
        if args.steps is None:
            raise ParamError("give --steps")
        spark = spark or SparkSession.builder.appName("tidefold").getOrCreate()
        rows = wide(simulate(spark, model, args.steps, args.series, args.seed), model.dim_x, model.dim_y, args.without_x)
        write_csv(rows.orderBy("series", "k").drop("series", "k") if args.series == 1 else rows, args.out or default_name(args.model, model.linear))
        return 0
    settings = {"upkf": {"sigma_set": args.sigma_set}, "ukf": {"sigma_set": args.sigma_set}} | {m: {"n_particles": args.particles, "resampling": args.resampling, "seed": args.seed} for m in ("pf", "ppf")}
    wanted = RunOptions(args.verbose, args.out is not None, args.out)
    one = Run(args.method, model, args.steps, args.data, args.series, args.seed, wanted, settings=settings.get(args.method, {}))
    spark = spark or SparkSession.builder.appName("tidefold").getOrCreate()
    print(text_table(one.scores(spark), latex=args.latex, digits=6))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--config" in argv:
        try:
            values = tomllib.loads(Path(argv[argv.index("--config") + 1]).read_text())
        except (IndexError, OSError, ValueError) as e:
            print(f"--config: {e}", file=sys.stderr)
            return 2
        command = next((a for a in argv if a in ("filter", "simulate", "models")), None)
        if command:
            for k, v in values.items():
                if f"--{k}" not in argv:
                    argv += [f"--{k}", str(v)]
    args = p.parse_args(argv)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[args.verbose])
    try:
        return run(args, spark)
    except TidefoldError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.exit_code
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
