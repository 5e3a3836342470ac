import json
import threading

import pytest

from logsentinel import cli
from logsentinel.control import jobs, logs, users

from .logs import access, at


class Slow:
    def __init__(self):
        self.go = threading.Event()

    def run(self, job, cancel):
        self.go.wait(10)
        if job.files[0] == "bad":
            raise ValueError("token=abc")
        return {"events": 1, "failures": 0, "findings": [{"severity": "LOW"}, {"severity": "HIGH"}]}


def test_queue():
    worker, done = Slow(), []
    q = jobs.JobQueue(worker, workers=1, max_pending=3, on_done=lambda j: done.append(q.get(j.job_id).status))
    first = q.submit(["a"])
    while q.get(first).status != jobs.JobStatus.RUNNING:
        pass
    rest = [q.submit([x]) for x in ("bad", "b", "c")]
    with pytest.raises(jobs.QueueFull):
        q.submit(["d"])
    assert q.cancel(rest[2]) and not q.cancel("none")
    worker.go.set()
    got = [q.wait(j).status.value for j in (first, *rest)]
    assert got == ["done", "failed", "done", "cancelled"] and done[0] == jobs.JobStatus.RUNNING
    assert q.get(rest[0]).error == "token=[REDACTED]" and [f["severity"] for f in q.findings()] == ["HIGH", "HIGH", "LOW", "LOW"]
    assert len(q.list_jobs()) == 4 and q.shutdown()
    with pytest.raises(RuntimeError):
        q.submit(["e"])


def test_users():
    store, now = users.UserStore(), [0.0]
    store.add("ann", "Correct-Horse-1", users.Role.ADMIN)
    store.add("bob", "Correct-Horse-2")
    for bad in ("short", "alllowercaseletters"):
        with pytest.raises(ValueError):
            store.add("x", bad)
    with pytest.raises(ValueError):
        store.add("ann", "Correct-Horse-1")
    login = users.Login(store, lambda: now[0])
    assert login.login("ann", "Correct-Horse-1").role == users.Role.ADMIN
    for _ in range(5):
        with pytest.raises(users.AuthError):
            login.login("bob", "no")
    with pytest.raises(users.AuthError, match="locked"):
        login.login("bob", "Correct-Horse-2")
    now[0] = 901
    user = login.login("bob", "Correct-Horse-2")
    users.require(user, users.Permission.VIEW_FINDINGS)
    with pytest.raises(users.AuthError):
        users.require(user, users.Permission.MANAGE_USERS)
    assert [u.username for u in store.list_users()] == ["ann", "bob"] and store.remove("bob") and not store.remove("bob")


def test_tool_log(spark, tmp_path):
    p = tmp_path / "app.jsonl"
    p.write_text("".join(json.dumps({"ts": str(i), "level": "INFO" if i % 2 else "ERROR", "message": "m"}) + "\n" for i in range(600)) + "bad\n")
    got = [r.line for r in logs.read_tool_log(spark, str(p), "ERROR").collect()]
    assert got[-1] == "598 ERROR m" and len(got) == 249 + 0


def test_cli(spark, tmp_path, capsys):
    f = tmp_path / "a.log"
    f.write_text("".join(access(at(5 * i), path="/login", status=401) + "\n" for i in range(6)))
    out = tmp_path / "o.json"
    assert cli.main(["analyze", str(f), "--export", "json", "--output", str(out)]) == 1
    assert [x["rule_id"] for x in json.loads(out.read_text())] == ["web-brute-force"] and "1 finding(s) across 6 event(s); 0 line(s)" in capsys.readouterr().out
    assert cli.main(["analyze", str(f), "--min-severity", "critical"]) == 0
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2 and "not found" in capsys.readouterr().err


def test_lock_goes_on_after_it_ends():
    """After a lock has ended each wrong password locks again at once, until the right one comes."""
    store, now = users.UserStore(), [0.0]
    store.add("bob", "Correct-Horse-2")
    login = users.Login(store, lambda: now[0])
    for _ in range(5):
        with pytest.raises(users.AuthError):
            login.login("bob", "no")
    now[0] = 901
    with pytest.raises(users.AuthError, match="wrong"):
        login.login("bob", "no")
    with pytest.raises(users.AuthError, match="locked"):
        login.login("bob", "Correct-Horse-2")
    now[0] = 1802
    assert login.login(" bob ", "Correct-Horse-2").failed_attempts == 0
    with pytest.raises(users.AuthError, match="wrong"):
        login.login("bob", "no")


def test_hash_costs_and_kinds():
    kind, n, r, p, salt, _ = users.hash_password("x").split("$")
    assert (kind, n, r, p) == ("scrypt", "32768", "8", "1") and len(__import__("base64").b64decode(salt)) == 32
    assert users.verify_password("x", users.hash_password("x")) and not users.verify_password("y", users.hash_password("x")) and not users.verify_password("x", "scrypt$1")
    assert users.kinds_of("aB1-") == {"lower", "upper", "digit", "other"} and users.kinds_of("\u00e9\u4e2d") == {"lower", "other"}


def test_permission_matrix():
    may = {r: users.PERMISSIONS[r] for r in users.Role}
    p = users.Permission
    assert may[users.Role.ADMIN] == set(p)
    assert set(p) - may[users.Role.ANALYST] == {p.STOP_ANY_JOB, p.VIEW_ALL_TOOL_LOGS, p.MANAGE_USERS, p.MANAGE_RULES}
    ann, bob = users.User("ann", "", users.Role.ADMIN), users.User("bob", "", users.Role.ANALYST)
    worker = Slow()
    q = jobs.JobQueue(worker, workers=1)
    mine, other = q.submit(["a"], "bob"), q.submit(["b"], "ann")
    with pytest.raises(users.AuthError):
        q.cancel_as(bob, other)
    assert q.cancel_as(ann, other) and q.cancel_as(bob, mine)
    worker.go.set()
    assert q.shutdown()
    users.require_own_or(bob, "bob", p.VIEW_OWN_TOOL_LOGS, p.VIEW_ALL_TOOL_LOGS)
    with pytest.raises(users.AuthError):
        users.require_own_or(bob, "ann", p.VIEW_OWN_TOOL_LOGS, p.VIEW_ALL_TOOL_LOGS)


def test_users_command(tmp_path, capsys, monkeypatch):
    db = str(tmp_path / "u.db")
    monkeypatch.setenv("LOGSENTINEL_NEW_PASSWORD", "Correct-Horse-9")
    assert cli.main(["users", "seed-demo", "--store", db]) == 0 and cli.main(["users", "seed-demo", "--store", db]) == 0
    assert "added: demo-analyst, demo-admin" in capsys.readouterr().out
    for name, password, code in (("demo-analyst", users.DEMO[0][1], 2), ("demo-admin", users.DEMO[1][1], 0)):
        monkeypatch.setenv("LOGSENTINEL_USER", name)
        monkeypatch.setenv("LOGSENTINEL_PASSWORD", password)
        assert cli.main(["users", "add", "eve", "--store", db]) == code
    assert cli.main(["users", "list", "--store", db]) == 0 and "eve analyst" in capsys.readouterr().out
    assert cli.main(["users", "remove", "none", "--store", db]) == 2


def test_commands_are_discovered(tmp_path, monkeypatch):
    folder = tmp_path / "morecommands"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "hello.py").write_text("def register(commands):\n    commands.add_parser('hello').set_defaults(run=lambda args: 7)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("LOGSENTINEL_COMMANDS", "morecommands,not.there")
    assert cli.main(["hello"]) == 7


def test_logs_are_configured_once(tmp_path):
    for _ in range(3):
        logs.configure_logging(str(tmp_path))
    __import__("logging").getLogger("logsentinel").warning("token=abc")
    assert (tmp_path / "app.log").read_text().count("token=[REDACTED]") == 1


def test_twenty_jobs_and_a_full_queue():
    """20 jobs of 300 units end well within a minute; a full queue says so at once; shutdown takes no longer than a job."""
    import time

    class Quick:
        def run(self, job, cancel):
            return {"events": 300, "failures": 0, "findings": []}

    q = jobs.JobQueue(Quick(), workers=4, max_pending=32)
    began = time.monotonic()
    ids = [q.submit([str(i)]) for i in range(20)]
    assert {q.wait(i).status.value for i in ids} == {"done"} and time.monotonic() - began < 10
    assert q.shutdown() and time.monotonic() - began < 20
    slow = Slow()
    q = jobs.JobQueue(slow, workers=1, max_pending=8)
    full = 0
    for i in range(24):
        at = time.monotonic()
        try:
            q.submit([str(i)])
        except jobs.QueueFull:
            full += 1
            assert time.monotonic() - at < 0.1
    assert full >= 15
    slow.go.set()
    assert q.shutdown()
