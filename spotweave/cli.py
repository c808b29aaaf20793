"""Command line: ``spotweave run`` and ``spotweave validate``."""

from __future__ import annotations

import argparse
import importlib
import logging
from collections.abc import Callable
from dataclasses import dataclass

from spotweave import __version__

METHODS = ("average", "ward")


@dataclass(frozen=True)
class Mode:
    """A way to call a command: it applies when all ``when`` options are given, and then
    needs ``required`` and excludes ``excluded``."""

    when: tuple[str, ...]
    required: tuple[str, ...]
    excluded: tuple[str, ...]
    call: Callable[[object, argparse.Namespace], int]

    def problems(self, args: argparse.Namespace) -> list[str]:
        given = {name for name, value in vars(args).items() if value is not None}
        lacking = [f"--{name} is needed" for name in self.required if name not in given]
        return lacking + [f"--{name} does not go with this call" for name in self.excluded if name in given]


def _sweep_config(args: argparse.Namespace):
    from dataclasses import fields

    from spotweave.plans.sweep import SweepConfig

    return SweepConfig(**{f.name: getattr(args, f.name) for f in fields(SweepConfig) if hasattr(args, f.name)})


def _run_pair(spark, args: argparse.Namespace) -> int:
    from spotweave.plans import sweep

    sweep.run_pair(spark, args.scdata, args.stdata, args.output_dir, _sweep_config(args))
    return 0


def _run_table(spark, args: argparse.Namespace) -> int:
    from spotweave.plans import sweep

    jobs = sweep.run_batch(spark, args.pairs_csv, args.sc_dir, args.st_dir, args.output_dir, _sweep_config(args))
    jobs.where("status <> 'done'").select("pair", "status", "detail").show(truncate=False)
    return 0


def _validate_pair(spark, args: argparse.Namespace) -> int:
    from spotweave.plans import validation

    return validation.validate_single(spark, args.scdata, args.stdata)


def _validate_table(spark, args: argparse.Namespace) -> int:
    from spotweave.plans import validation

    return validation.validate_pairs(spark, args.pairs_csv, args.sc_dir, args.st_dir)


# The first mode whose ``when`` is met counts; the last one always is.
MODES = {
    "run": (
        Mode(("pairs_csv",), ("sc_dir", "st_dir", "output_dir"), (), _run_table),
        Mode((), ("scdata", "stdata", "output_dir"), (), _run_pair),
    ),
    "validate": (
        Mode(("pairs_csv",), (), ("scdata", "stdata"), _validate_table),
        Mode((), ("scdata", "stdata"), ("sc_dir", "st_dir"), _validate_pair),
    ),
}


def _aligner(text: str) -> str:
    """Registers ``name=module:function`` and returns the name."""
    from spotweave.operators import mappers

    name, _, place = text.partition("=")
    module, _, function = place.partition(":")
    try:
        mappers.register_aligner(name, getattr(importlib.import_module(module), function))
    except (ImportError, AttributeError, ValueError) as problem:
        raise argparse.ArgumentTypeError(f"no aligner at {text!r}: {problem}") from None
    return name


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spotweave")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    inputs = {"scdata": "folder of one reference matrix", "stdata": "folder of one spatial matrix", "pairs_csv": "table of pairs", "sc_dir": "folder of references", "st_dir": "folder of spatial matrices"}
    for name in MODES:
        sub = commands.add_parser(name)
        for option, text in inputs.items():
            sub.add_argument(f"--{option}", help=text)
        sub.add_argument("--logging", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    run = commands.choices["run"]
    run.add_argument("--output_dir")
    run.add_argument("--aligner", action="append", type=_aligner, help="name=module:function, makes a mapper of an own function")
    run.add_argument("--mapping", default="nearest_centroid")
    run.add_argument("--leiden_resolution", type=float, default=3.0)
    run.add_argument("--linkage_method", choices=METHODS, default="average")
    run.add_argument("--start_from_annotation")
    run.add_argument("--k_min", type=int)
    run.add_argument("--k_max", type=int)
    run.add_argument("--k_step", type=int, default=1)
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    mode = next(m for m in MODES[args.command] if all(getattr(args, w) is not None for w in m.when))
    problems = mode.problems(args)
    if args.command == "run":
        from spotweave.operators import mappers

        if args.mapping not in mappers.mapper_names():
            problems.append(f"--mapping is none of {', '.join(mappers.mapper_names())}")
    if problems:
        top.error("; ".join(problems))
    logging.basicConfig(level=args.logging)
    from spotweave.session import build_session

    return mode.call(build_session(f"spotweave {args.command}"), args)
