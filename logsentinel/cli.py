"""Command line. Exit codes: 0 nothing loud, 1 a high finding is shown, 2 a usage or input error."""

from __future__ import annotations

import argparse
import sys

from .commands import discovered
from .functions.text import redact_text
from .rules import ConfigError, apply_env, load_env_file
from .sources.parsers import UnknownFormatError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logsentinel")
    top.add_argument("--env-file", default=".env")
    commands = top.add_subparsers(dest="command", required=True)
    for module in discovered():
        module.register(commands)
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    wrong = args.check(args) if hasattr(args, "check") else None
    if wrong:
        top.error(wrong)
    apply_env(load_env_file(args.env_file))
    try:
        return args.run(args)
    except (ConfigError, UnknownFormatError) as e:
        print(f"error: {redact_text(e)}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
