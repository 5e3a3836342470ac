"""users: accounts of the tool. Once there are any, an admin must sign in to see or change them."""

from __future__ import annotations

import argparse
import getpass
import os

from ..control.users import AuthError, Login, Permission, Role, UserStore, require, seed_demo
from ..rules import ConfigError


def register(commands) -> None:
    p = commands.add_parser("users", help="add, list and remove accounts; seed-demo adds two to try the tool with")
    p.set_defaults(run=run, check=lambda args: "a user name is needed" if args.do in ("add", "remove") and not args.username else None)
    p.add_argument("do", choices=["add", "list", "remove", "seed-demo"])
    p.add_argument("username", nargs="?")
    p.add_argument("--role", default=Role.ANALYST.value, choices=[r.value for r in Role])
    p.add_argument("--store", default="users.db")


def _sign_in(store: UserStore) -> None:
    """As LOGSENTINEL_USER with LOGSENTINEL_PASSWORD, asked for where they are not set."""
    name = os.environ.get("LOGSENTINEL_USER") or input("user: ")
    require(Login(store).login(name, os.environ.get("LOGSENTINEL_PASSWORD") or getpass.getpass()), Permission.MANAGE_USERS)


def run(args: argparse.Namespace) -> int:
    store = UserStore(args.store)
    try:
        if args.do == "seed-demo":
            print("added: " + (", ".join(seed_demo(store)) or "none, they are there"))
            return 0
        if store.list_users():
            _sign_in(store)
        if args.do == "list":
            for u in store.list_users():
                print(u.username, u.role.value)
        elif args.do == "remove":
            if not store.remove(args.username):
                raise ConfigError(f"no user {args.username!r}")
        else:
            store.add(args.username, os.environ.get("LOGSENTINEL_NEW_PASSWORD") or getpass.getpass("new password: "), Role(args.role))
    except (AuthError, ValueError) as e:
        raise ConfigError(str(e)) from e
    return 0
