"""Streams with state, also after a restart on the same checkpoint."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from weftline.streaming import stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, key string, at timestamp, _occurrence_ string"


@pytest.fixture
def feed(spark, tmp_path):
    """Files that become micro-batches: ``feed.add(rows)`` writes one, ``feed.stream()`` reads the folder."""

    class Feed:
        def __init__(self, name):
            self.folder = str(tmp_path / name)
            self.n = 0

        def add(self, rows):
            self.n += 1
            df = spark.createDataFrame([(i, k, None if m is None else T0 + timedelta(minutes=m), "x") for i, k, m in rows], SCHEMA)
            df.coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self):
            return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.folder)

    return Feed


def go(spark, df, tmp_path, name):
    stateful.run_once(df, str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"))
    return spark.read.parquet(str(tmp_path / name / "out"))


def test_repeated_rows_are_known_after_a_restart(spark, feed, tmp_path):
    f = feed("a")
    f.add([(1, "x", 0), (2, "y", 1), (3, "x", 2), (4, None, 2), (5, "z", None)])
    flagged = lambda: stateful.unique_rows(f.stream(), "key", "at", late="1 hour")
    first = go(spark, flagged(), tmp_path, "q")
    assert {r.id: list(r._violations) for r in first.collect()} == {1: [], 2: [], 3: ["unique(key)"]}
    f.add([(6, "x", 5), (7, "w", 6)])
    f.add([(8, "w", 7), (9, "y", 8)])
    again = go(spark, flagged(), tmp_path, "q")  # a new query on the old checkpoint
    assert {r.id for r in again.collect() if r._violations} == {3, 6, 8, 9} and again.count() == 7


def test_state_is_forgotten_and_late_rows_are_left_out(spark, feed, tmp_path):
    f = feed("b")
    for rows in ([(1, "x", 0)], [(2, "far", 600)], [(3, "far", 601)], [(4, "late", 10)], [(5, "x", 700)]):
        f.add(rows)
        out = go(spark, stateful.occurrences(f.stream(), "key", "at", late="10 minutes", keep_hours=1), tmp_path, "q")
    assert {r.id: r._occurrence for r in out.collect()} == {1: 1, 2: 1, 3: 2, 5: 1}


def test_sessions_end_when_event_time_passes(spark, feed, tmp_path):
    f = feed("c")
    f.add([(1, "x", 0), (2, "x", 10), (3, "y", 3)])
    f.add([(4, "x", 20), (5, "x", 60), (6, None, 60)])
    f.add([(7, "end", 500)])
    f.add([(8, "end", 501)])
    got = go(spark, stateful.sessions(f.stream(), "key", "at"), tmp_path, "q")
    minute = lambda t: int((t - T0).total_seconds() // 60)
    assert Counter((r.key, minute(r.start), minute(r.end), r.n_rows) for r in got.collect()) == Counter([("x", 0, 35, 3), ("x", 60, 75, 1), ("y", 3, 18, 1)])


def test_keys_of_another_stream(spark, feed, tmp_path):
    child, parent = feed("d"), feed("e")
    child.add([(1, "x", 0), (2, "q", 1), (3, "late parent", 5), (4, None, 5)])
    parent.add([(1, "x", 3), (2, "late parent", 300)])
    child.add([(9, "end", 900)])
    parent.add([(9, "end", 900)])
    child.add([(10, "end", 901)])
    parent.add([(10, "end", 901)])
    got = go(spark, stateful.orphans(child.stream(), "key", "at", parent.stream(), "key", "at"), tmp_path, "q")
    assert {r.id for r in got.collect()} == {2, 3}


def test_many_keys_share_few_groups(spark, tmp_path, monkeypatch):
    """A group costs milliseconds whatever it holds, so single keys are no groups of their own."""
    rows = [(i, [0.0, -0.0, 1.5, 2.5][i % 4], f'k"{i % 7},', T0 + timedelta(minutes=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, k string, at timestamp")
    df.where("id < 1000").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("id >= 1000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(stateful, "BUCKETS", 3, raising=False)
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    numbered = stateful.occurrences(feed, ["x", "k"], "at", late="3650 days", keep_hours=24 * 3650)
    query = stateful.run_once(numbered, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    ranks = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        ranks.setdefault((r.x + 0.0, r.k), []).append(r._occurrence)
    assert len(ranks) == 21 and sum(map(len, ranks.values())) == 3000
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) < 21
