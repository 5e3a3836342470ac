"""analyze: findings of log files, in one batch."""

from __future__ import annotations

import argparse

from ..plans.analyze import analyze, at_least, exit_code, nested
from ..rules import DEFAULT_RULES, load_rules
from ..session import session
from ..sinks.alerts import build_dispatcher
from ..sinks.export import WRITERS, report, write
from ..sources.parsers import PARSERS


def register(commands) -> None:
    p = commands.add_parser("analyze", help="findings of log files, folders or patterns")
    p.set_defaults(run=run, check=lambda args: "--export needs --output" if args.export and not args.output else None)
    p.add_argument("files", nargs="+")
    p.add_argument("--rules", default=str(DEFAULT_RULES))
    p.add_argument("--format", default="auto", choices=["auto", *(x.name for x in PARSERS)])
    p.add_argument("--min-severity")
    p.add_argument("--export", choices=sorted(WRITERS))
    p.add_argument("--output")
    p.add_argument("--alert", action="store_true")


def run(args: argparse.Namespace) -> int:
    config, spark = load_rules(args.rules), session()
    result = analyze(spark, args.files, config, args.format, apart=True)
    shown = (at_least(result.findings, args.min_severity) if args.min_severity else result.findings).persist()
    try:
        n = result.totals()
        print(report(shown, n["events"], n["failures"]))
        if args.export:
            write(shown, args.output, args.export, result.evidence)
            print(f"wrote {args.output}")
        if args.alert:
            for o in build_dispatcher(config.alerts).dispatch(nested(result.findings, result.evidence)):  # sinks get whole findings
                print(f"alert {o.sink}: {'sent' if o.ok else 'failed: ' + (o.error or '')}")
        return exit_code(shown)
    finally:
        shown.unpersist()
        result.unpersist()
