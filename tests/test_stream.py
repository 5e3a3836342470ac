import random
import time

import pytest
from pyspark.sql import functions as F

from logsentinel.rules import RuleConfig, load_rules
from logsentinel.schema import FINDING
from logsentinel.streaming.detector import TrailingWindow, fires_of
from logsentinel.streaming.tail_source import TailReader
from logsentinel.streaming.watch import WatchSession

from .logs import EXPECTED, access, at, attack, failed


def test_tail(tmp_path):
    p = tmp_path / "a.log"
    r = TailReader([str(p), str(tmp_path / "missing")], "apache", 64)
    rows, o = r.read(r.initialOffset())
    assert not list(rows)
    p.write_bytes(b"one\r\ntwo\npart")
    rows, o1 = r.read(o)
    assert [x[2:4] for x in rows] == [(1, "one"), (2, "two")]
    with p.open("ab") as f:
        f.write(b"ial\n" + b"x" * 200 + b"\n")
    rows, o2 = r.read(o1)
    assert [x[2:4] for x in rows] == [(3, "partial")]
    rows, o3 = r.read(o2)
    assert [x[3] for x in rows] == ["x" * 200]
    assert [x[2:4] for x in r.readBetweenOffsets(o1, o2)] == [(3, "partial")]
    p.write_bytes(b"new\n")
    assert [x[2:4] for x in r.read(o3)[0]] == [(1, "new")]


def test_tail_waits_for_format(tmp_path):
    p = tmp_path / "a.log"
    p.write_text("".join(f"junk {i}\n" for i in range(150)))
    r = TailReader([str(p)])
    rows, o = r.read(r.initialOffset())
    assert not list(rows) and o["0"][2] == 50
    with p.open("a") as f:
        f.write("".join(access(at(i)) + "\n" for i in range(200)))
    rows = list(r.read(o)[0])
    assert len(rows) == 300 and rows[0][2] == 51 and rows[-1][4] == "apache"


@pytest.mark.parametrize("kind,params", [("brute-force", {"threshold": 6}), ("scanner-burst", {"threshold": 4}), ("brute-force-success", {"threshold": 5})])
def test_windows_match_plain_lists(kind, params):
    """Batches of unordered rows, late ones among them, against lists that are filtered anew for each row."""
    r = random.Random(7)
    rule = RuleConfig("r", kind, True, "high", None, 10, params)
    for _ in range(40):
        kept, window, fired = [], TrailingWindow(), None
        for _ in range(6):
            batch = sorted(((r.randrange(0, 60) * 1_000_000, 0, 0, k, "f", "", r.choice([None, "a", "b", "c", "d", "e"])), r.random() < 0.7) for k in range(r.randrange(0, 12)))
            want = None
            for row, counts in batch:
                kept = [x for x in kept if x[0] >= row[0] - 10_000_000] + ([row] if counts else [])
                n = len({x[-1] for x in kept if x[-1]}) if kind == "scanner-burst" else len(kept)
                if want is None and n >= params["threshold"] and (kind != "brute-force-success" or not counts):
                    want = kept + ([] if counts else [row])
                    break
            got, done = fires_of(iter(batch), rule, window)
            assert ([h for h, *_ in got] == ([want] if want else [])) and done == bool(want)
            window = TrailingWindow(list(window.rows.values()))  # as it is stored
            if done:
                break


def test_many_rows_of_one_key_in_time():
    """100,000 rows of one key in one window that doesn't fire, and 100,000 that come and go: no row looks at all others."""
    rule = RuleConfig("r", "scanner-burst", True, "high", None, 100, {"threshold": 5})
    for step in (0, 10_000):
        window = TrailingWindow()
        began = time.monotonic()
        rows = ((i * step, 0, 0, i, "f", "", "same") for i in range(100_000))
        assert fires_of(((x, True) for x in rows), rule, window) == ([], False)
        assert time.monotonic() - began < 10 and len(window.rows) == (100_000 if not step else 10_001)


def test_correlation_reads_the_last_batch_only(spark, tmp_path):
    """What is left open doesn't grow with the batches: findings out of the window go, and two folders stay."""
    session = WatchSession(spark, [str(tmp_path / "a.log")], load_rules(), str(tmp_path / "cp"))
    found = analyze_rows(spark, at(0))
    sizes = []
    for batch in range(6):
        late = found.withColumns({c: F.col(c) + F.expr(f"INTERVAL {batch * 400} SECONDS") for c in ("first_seen", "last_seen")})
        out = session._correlated(late, batch).collect()
        assert len([x for x in out if x.rule_id == "multi-vector-correlation"]) == (1 if batch == 0 else 0)
        sizes.append(spark.read.parquet(str(tmp_path / f"cp/open/batch={batch}")).count())
        assert session._folders("open") == list(range(max(0, batch - 1), batch + 1))
    assert sizes == [3, 5, 5, 5, 5, 5]
    assert [x.rule_id for x in session._correlated(found.limit(0), 3).collect()] == []  # run again


def analyze_rows(spark, t):
    """Two findings of one ip from two sources."""
    rows = [(f"id{i}", rule, "HIGH", 30, "t", "d", t, t, 5, "10.0.0.50", [], [], [], i, (0, 0, 0, i)) for i, rule in enumerate(("web-brute-force", "ssh-brute-force"))]
    return spark.createDataFrame(rows, FINDING)


def test_watch_matches_batch_and_restarts(spark, tmp_path):
    web, ssh = attack()
    files = [tmp_path / "access.log", tmp_path / "auth.log"]
    for f in files:
        f.write_text("")
    got = []
    args = (spark, [str(f) for f in files], load_rules(), str(tmp_path / "cp"))
    session = WatchSession(*args, reference=at(900), on_findings=got.extend)
    session.start()
    try:
        with files[0].open("a") as f:
            f.write("\n".join(web[:14]) + "\n")
        session.process_available()
        assert not [x for x in got if x["rule_id"] == "web-brute-force"]
    finally:
        session.stop()
    session = WatchSession(*args, reference=at(900), on_findings=got.extend)  # state survives
    session.start()
    try:
        with files[0].open("a") as f:
            f.write("\n".join(web[14:]) + "\n")
        with files[1].open("a") as f:
            f.write("\n".join(ssh[:-2]) + "\n")
        session.process_available()
        with files[1].open("a") as f:  # later than the correlation window: earlier findings leave it
            f.write("\n".join(ssh[-2:]) + "\n")
        session.process_available()
        single = lambda rows: sorted(((r, i or "", u, n) for r, _, i, u, n in rows if r != "multi-vector-correlation"), key=str)
        assert single([(x["rule_id"], "", x["ip"], x["users"], x["count"]) for x in got]) == single(EXPECTED)
        # the latest finding of the same poll is over a correlation window later than those of 10.0.0.50
        assert {x["ip"] for x in got if x["rule_id"] == "multi-vector-correlation"} == {"203.0.113.5"}
        n = len(got)
        with files[1].open("a") as f:
            f.write("\n".join(failed(at(905 + i)) for i in range(6)) + "\n")
        session.process_available()
        assert not [x for x in got[n:] if x["rule_id"] == "ssh-brute-force"]  # once an ip
    finally:
        session.stop()


def test_totals_outlive_the_session(spark, tmp_path):
    """Totals are those of all batches, not of the last hundred, and go on after a restart; quiet polls leave no folder."""
    f = tmp_path / "access.log"
    f.write_text("".join(access(at(i)) + "\n" for i in range(10)))
    args = (spark, [str(f)], load_rules(), str(tmp_path / "cp"))
    session = WatchSession(*args, interval=0.1)
    session.run(max_seconds=60, max_polls=4)
    assert session.counters() == {"events": 10, "failures": 0, "findings": 0}
    with f.open("a") as out:
        out.write("broken\n" + "".join(access(at(100 + i), path="/login", status=401) + "\n" for i in range(6)))
    session = WatchSession(*args, interval=0.1)
    session.start()
    try:
        session.process_available()
        assert session.counters() == {"events": 16, "failures": 1, "findings": 1}
    finally:
        session.stop()
    assert WatchSession(*args).counters() == {"events": 16, "failures": 1, "findings": 1}
    assert len(list((tmp_path / "cp" / "findings").glob("batch=*"))) == 1
