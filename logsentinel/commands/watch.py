"""watch: follow log files and report as they grow."""

from __future__ import annotations

import argparse

from ..functions.text import redact_text
from ..rules import DEFAULT_RULES, load_rules
from ..session import session, shared_folder
from ..sources.parsers import PARSERS


def register(commands) -> None:
    p = commands.add_parser("watch", help="follow log files")
    p.set_defaults(run=run)
    p.add_argument("files", nargs="+")
    p.add_argument("--rules", default=str(DEFAULT_RULES))
    p.add_argument("--format", default="auto", choices=["auto", *(x.name for x in PARSERS)])
    p.add_argument("--interval", type=float, default=0.5)
    p.add_argument("--seconds", type=float)
    p.add_argument("--polls", type=int)
    p.add_argument("--checkpoint")


def _show(findings) -> None:
    for f in findings:
        print(redact_text(f"[{f['severity']}] {f['rule_id']}: {f['title']} ({f['count']})"), flush=True)


def run(args: argparse.Namespace) -> int:
    from ..streaming.watch import WatchSession

    spark = session()
    watch = WatchSession(spark, args.files, load_rules(args.rules), args.checkpoint or shared_folder(spark, "watch"), args.format, args.interval, on_findings=_show)
    watch.run(max_seconds=args.seconds, max_polls=args.polls)
    n = watch.counters()
    print(f"{n['findings']} finding(s) across {n['events']} event(s); {n['failures']} line(s) failed to parse.")
    return 0
