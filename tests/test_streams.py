"""Streams with state that expires, and facts that are merged once: several micro-batches, restarts and replays."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from tallyfield.streaming import facts, limits, state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "id bigint, ts timestamp, key bigint, ledger string, cost double"


def log_rows(seed, n, keys, step):
    r, at, rows = random.Random(seed), 0, []
    for k in range(n):
        at += r.randrange(step)
        rows.append((k, START + timedelta(microseconds=at), r.randrange(keys), r.choice(["ask", "ask", "run"]), 1.0))
    return rows


def stream_of(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder))


def write(spark, rows, folder):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def brute_unanswered(rows, delay, grace):
    us = lambda t: round((t - START).total_seconds() * 1_000_000)
    passed = max(us(r[1]) for r in rows) // 1000 * 1000 - delay
    by = defaultdict(list)
    for id_, ts, key, ledger, _ in rows:
        if us(ts) < passed:
            by[key].append((us(ts), id_, ledger == "ask"))
    out = []
    for key, found in by.items():
        found.sort()
        for k, (at, id_, ask) in enumerate(found):
            after = found[k + 1] if k + 1 < len(found) else None
            if not ask:
                continue
            if after and after[0] - at <= grace:
                out.append((id_, key, "superseded" if after[2] else "answered", (after[0] - at) / 1e6))
            elif at + grace < passed:
                out.append((id_, key, "lost", None))
    return sorted(out)


def test_unanswered_requests_over_restarts_and_out_of_order(spark, tmp_path):
    rows = log_rows(1, 600, 9, 20_000_000)
    want = brute_unanswered(rows, 600_000_000, 90_000_000)
    assert {o for _, _, o, _ in want} == {"answered", "superseded", "lost"}
    shuffled, r = [], random.Random(2)
    for k in range(0, len(rows), 20):  # some three minutes each, within the watermark's delay
        part = rows[k : k + 20]
        r.shuffle(part)
        shuffled += part
    for k in range(0, len(shuffled), 30):
        write(spark, shuffled[k : k + 30], tmp_path / "log")
        if k in (210, 420, 570):  # the run stops, and a new one goes on from the checkpoint
            with state.expiring_state(spark):
                found = limits.run_to_end(state.unanswered(stream_of(spark, tmp_path / "log"), "ledger = 'ask'"), "append", str(tmp_path / "run"))
    assert sorted(tuple(x) for x in found.collect()) == want


def test_unanswered_requests_in_one_batch_or_none(spark, tmp_path):
    rows = log_rows(4, 200, 3, 30_000_000)
    write(spark, rows, tmp_path / "log")
    with state.expiring_state(spark):
        found = limits.run_to_end(state.unanswered(stream_of(spark, tmp_path / "log"), "ledger = 'ask'"), "append")
        assert sorted(tuple(x) for x in found.collect()) == brute_unanswered(rows, 600_000_000, 90_000_000)
        spark.createDataFrame([], LOG).write.parquet(str(tmp_path / "none"))
        assert limits.run_to_end(state.unanswered(stream_of(spark, tmp_path / "none"), "ledger = 'ask'"), "append").count() == 0


def test_hours_expire(spark, tmp_path):
    rows = [(k, START + timedelta(seconds=k), 7, "ask", 1.0) for k in range(12)]
    folder, run = tmp_path / "log", str(tmp_path / "run")
    tally = lambda keep: limits.run_to_end(state.hour_admission(stream_of(spark, folder), 5, keep), "append", run)
    with state.expiring_state(spark, by_clock=True):
        write(spark, rows[:4], folder)
        tally(5)
        write(spark, rows[4:8], folder)  # the hour goes on in a later run
        assert {x.id: x.allowed for x in tally(5).collect()} == {k: k < 5 for k in range(8)}
        time.sleep(6)
        write(spark, rows[8:], folder)  # by now its tally is gone
        assert {x.id: (x.used, x.allowed) for x in tally(5).where(F.col("id") >= 8).collect()} == {8 + k: (k, True) for k in range(4)}


def test_hours_go_on_in_later_runs(spark, tmp_path):
    folder, run = tmp_path / "log", str(tmp_path / "run")
    rows = [(k, START + timedelta(seconds=1200 * k), k % 2, "ask", 1.0) for k in range(18)]  # three of an hour, of both keys
    with state.expiring_state(spark, by_clock=True):
        for part in (rows[::2], rows[1::2]):
            write(spark, [(10 * r[0] + k, *r[1:]) for r in part for k in range(2)], folder)
            write(spark, [(10 * r[0] + k, *r[1:]) for r in part for k in range(2, 4)], folder)
            found = limits.run_to_end(state.hour_admission(stream_of(spark, folder), 3, 600), "append", run)
    tallies = defaultdict(list)
    for r in found.collect():
        tallies[r.key, r.hour].append(r.used)
    assert found.count() == 72 and all(sorted(v) == [min(k, 3) for k in range(len(v))] for v in tallies.values())


def test_hours_of_a_key_are_one_group():
    class Kept:
        rows = []

        def get(self):
            return iter(self.rows)

        def appendValue(self, row):
            self.rows = [*self.rows, row]

    tally = state.HourTally(2, 1000)
    tally.used = Kept()
    ask = lambda *rows: [tuple(x) for f in tally.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["hour", "id", "at"])]), None) for x in f[["id", "hour", "used", "allowed"]].values.tolist()]
    assert ask(("b", 3, 30), ("a", 1, 10), ("b", 2, 20), ("a", 4, 11), ("a", 5, 12)) == [(1, "a", 0, True), (4, "a", 1, True), (5, "a", 2, False), (2, "b", 0, True), (3, "b", 1, True)]
    assert ask(("b", 6, 40), ("c", 7, 50)) == [(6, "b", 2, False), (7, "c", 0, True)]


# --- facts

FACT = "appid bigint, run bigint, cost bigint, at timestamp"


def fact(appid, run, cost, minutes):
    return appid, run, cost, START + timedelta(minutes=minutes)


BATCHES = [
    [fact(1, 1, 9, 0), fact(1, 2, None, 0), fact(2, 1, 14, 5), fact(2, 1, 13, 5)],
    [fact(1, 1, None, 9), fact(1, 2, 7, 1), fact(3, 1, None, 0), fact(1, 1, 8, -1)],
    [fact(1, 2, 7, 1), fact(3, 1, None, 4), fact(9, 9, 0, 0)],
]
MERGED = [fact(1, 1, 9, 0), fact(1, 2, 7, 1), fact(2, 1, 14, 5), fact(3, 1, None, 4), fact(9, 9, 0, 0)]


def state_of(table):
    return sorted((r.appid, r.run, r.cost, r.at.replace(tzinfo=None) if r.at.tzinfo else r.at.astimezone(timezone.utc).replace(tzinfo=None)) for r in table.read().collect())


def test_facts_in_any_order_and_again(spark, tmp_path):
    want = [(a, b, c, t.replace(tzinfo=None)) for a, b, c, t in MERGED]
    for name, order in (("one", [0, 1, 2]), ("two", [2, 1, 0]), ("three", [1, 0, 2])):
        table = facts.FactTable(spark, str(tmp_path / name), buckets=4)
        for k in order:  # each batch from a writer of its own
            assert table.merge(spark.createDataFrame(BATCHES[k], FACT), f"w{k}", 0)
        version, files = table.version(), table._version()[1]["files"]
        for k in order:
            assert not table.merge(spark.createDataFrame(BATCHES[k], FACT), f"w{k}", 0)
        assert table.version() == version and state_of(table) == want
        assert table.merge(spark.createDataFrame([fact(9, 9, 0, 0)], FACT), "w0", 1)
        after = table._version()[1]["files"]
        assert sum(after[b] != files.get(b) for b in after) == 1  # only the bucket of that key has new files
        assert table.merge(spark.createDataFrame([], FACT), "w0", 2) and state_of(table) == want
        table.vacuum()
        assert state_of(facts.FactTable(spark, str(tmp_path / name))) == want
        assert len(list((tmp_path / name / "log").glob("*.json"))) == 1


def test_no_update_is_lost_between_two_writers(spark, tmp_path, monkeypatch):
    table = facts.FactTable(spark, str(tmp_path / "t"), buckets=2)
    other = facts.FactTable(spark, str(tmp_path / "t"), buckets=2)
    create, cut_in = facts._Store.create, []

    def slow(self, file, content):
        if not cut_in:  # another writer commits between the read and the commit of this one
            cut_in.append(True)
            assert other.merge(spark.createDataFrame(BATCHES[1], FACT), "other", 0)
        return create(self, file, content)

    monkeypatch.setattr(facts._Store, "create", slow)
    assert table.merge(spark.createDataFrame(BATCHES[0], FACT), "mine", 0)
    assert table.version() == 2 and table.merge(spark.createDataFrame(BATCHES[2], FACT), "mine", 1)
    assert state_of(table) == [(a, b, c, t.replace(tzinfo=None)) for a, b, c, t in MERGED]


def test_facts_follow_a_stream_and_its_replay(spark, tmp_path):
    want = [(a, b, c, t.replace(tzinfo=None)) for a, b, c, t in MERGED]
    table = facts.FactTable(spark, str(tmp_path / "t"))
    stream = lambda: spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:
            facts.follow(stream(), table, str(tmp_path / "log"))
    assert state_of(table) == want
    version = table.version()
    for commit in (tmp_path / "log" / "commits").glob("*"):  # the last batch runs again, as after a crash before its commit
        if commit.name.strip(".").split(".")[0] == str(len(BATCHES) - 1):
            commit.unlink()
    facts.follow(stream(), table, str(tmp_path / "log"))
    assert table.version() == version and state_of(table) == want
