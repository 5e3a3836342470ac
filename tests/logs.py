"""Builders of log lines."""

from datetime import UTC, datetime, timedelta

T0 = datetime(2025, 7, 3, 10, 15, tzinfo=UTC)


def at(seconds: int) -> datetime:
    return T0 + timedelta(seconds=seconds)


def access(ts: datetime = T0, ip: str = "10.0.0.50", path: str = "/", status: int = 200, method: str = "GET", user: str = "-", size: str = "1234") -> str:
    return f'{ip} - {user} [{ts:%d/%b/%Y:%H:%M:%S} +0000] "{method} {path} HTTP/1.1" {status} {size} "-" "Mozilla/5.0"'


def auth(ts: datetime = T0, message: str = "Accepted password for alice from 10.0.0.50 port 1 ssh2", prog: str = "sshd[1234]") -> str:
    return f"{ts:%b} {ts.day:2d} {ts:%H:%M:%S} web-01 {prog}: {message}"


def failed(ts: datetime, user: str = "root", ip: str = "10.0.0.50", invalid: bool = False) -> str:
    return auth(ts, f"Failed password for {'invalid user ' if invalid else ''}{user} from {ip} port 22 ssh2")


def attack() -> tuple[list[str], list[str]]:
    """Two log families with every kind of attack: what the golden test expects of them stands there."""
    web = [access(at(-60 + i), f"192.0.2.{i}", f"/page/{i}") for i in range(10)]
    web += [access(at(5 * i), path="/login", status=401) for i in range(8)] + [access(at(45), path="/home", status=302)]
    scans = ["/.env", "/.git/config", "/admin", "/phpmyadmin", "/wp-admin", "/config.php"]
    web += [access(at(300 + 4 * i), "203.0.113.5", p, 404) for i, p in enumerate(scans)]
    web += [access(at(335), "203.0.113.5", "/../../etc/passwd", 400), access(at(338), "203.0.113.5", "/x?f=%2e%2e%2fetc", 400), "garbage line"]
    web += [access(at(600), "198.51.100.23", "/q?s=1%20UNION%20SELECT%202"), access(at(605), "198.51.100.23", "/q?s=%27%20or%20%271%27=%271"), access(at(609), "192.0.2.55", "/q?s=O'Brien")]
    web += [access(at(720 + 3 * i), "45.33.32.1", "/api", 429) for i in range(5)]
    ssh = [auth(at(-30), "Accepted password for bob from 192.0.2.9 port 1 ssh2")]
    ssh += [failed(at(60 + 5 * i)) for i in range(6)] + [auth(at(100), "Accepted password for root from 10.0.0.50 port 22 ssh2")]
    ssh += [failed(at(360 + 5 * i), u, "203.0.113.5", True) for i, u in enumerate(["admin", "oracle", "postgres", "test", "admin"])]
    ssh += [auth(at(900), "  alice : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /etc/shadow", "sudo"), auth(at(901), "  bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls", "sudo")]
    return web, ssh


#: rule, severity, ip, users, count of each finding in report order.
EXPECTED = [
    ("web-brute-force", "HIGH", "10.0.0.50", [], 5), ("ssh-brute-force", "HIGH", "10.0.0.50", [], 5), ("ssh-brute-force", "HIGH", "203.0.113.5", [], 5),
    ("web-brute-force-success", "CRITICAL", "10.0.0.50", [], 9), ("ssh-brute-force-success", "CRITICAL", "10.0.0.50", [], 7), ("path-traversal", "HIGH", "203.0.113.5", [], 2),
    ("sqli-probe", "HIGH", "198.51.100.23", [], 2), ("scanner-burst", "MEDIUM", "203.0.113.5", [], 6), ("rate-limit-abuse", "MEDIUM", "45.33.32.1", [], 5),
    ("sudo-sensitive-command", "HIGH", None, ["alice"], 1), ("ssh-invalid-user-enum", "MEDIUM", "203.0.113.5", ["admin", "oracle", "postgres", "test"], 4),
    ("rapid-success-after-failures", "HIGH", "10.0.0.50", [], 7), ("multi-vector-correlation", "CRITICAL", "10.0.0.50", [], 33), ("multi-vector-correlation", "CRITICAL", "203.0.113.5", ["admin", "oracle", "postgres", "test"], 17),
]
