"""Commands of the command line: each module here, and in the packages that ``LOGSENTINEL_COMMANDS`` names, adds its own
through ``register(subparsers)`` and sets ``run``, a function of the parsed arguments that returns the exit code."""

from __future__ import annotations

import importlib
import logging
import os
import pkgutil
from types import ModuleType

log = logging.getLogger(__name__)


def discovered() -> list[ModuleType]:
    """Modules with a register function, by name; one that can't be imported is logged and left out if it is not ours."""
    out = []
    for package in [__name__, *filter(None, os.environ.get("LOGSENTINEL_COMMANDS", "").split(","))]:
        try:
            names = [m.name for m in pkgutil.iter_modules(importlib.import_module(package).__path__, f"{package}.")]
            found = [importlib.import_module(n) for n in sorted(names) if not n.rsplit(".", 1)[1].startswith("_")]
        except Exception as e:
            if package == __name__:
                raise
            log.warning("commands of %s left out: %s", package, e)
            continue
        out += [m for m in found if hasattr(m, "register")]
    return out
