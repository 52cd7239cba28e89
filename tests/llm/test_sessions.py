import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.llm import sessions as module
from weftline.llm.sessions import MINUTE, session_digests, sessions

START = datetime(2024, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, block int, us string, session int"


def plain(rows):
    """The contract, one client after the other."""
    best = {}
    for cid, ts, arrived, client, kind, value, *_ in rows:
        if client is None or ts is None:
            continue
        us = round((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        late = arrived is not None and (arrived - ts) > timedelta(minutes=15)
        final = value is not None and value >= 60 and kind in ("purchase", "signup")
        cents = 0 if value is None else int((100 * value + 0.5) // 1)
        key = (us, client, cents)
        if cid not in best or key < best[cid][0]:
            best[cid] = (key, (us, cid, client, late, final, cents))
    clients = {}
    for _, c in best.values():
        clients.setdefault(c[2], []).append(c)
    out = []
    for client, all_ in clients.items():
        timely = sorted(c for c in all_ if not c[3])
        found = []
        for c in timely:
            if found:
                last, first = found[-1][-1], found[-1][0]
                why = "end" if last[4] else "gap" if c[0] - last[0] >= 15 * MINUTE else "length" if c[0] - first[0] > 60 * MINUTE else None
                if why is None:
                    found[-1].append(c)
                    continue
                reasons[-1] = why
            else:
                reasons = []
            found.append([c])
            reasons.append("end?")
        for i, s in enumerate(found):
            until = found[i + 1][0][0] if i + 1 < len(found) else float("inf")
            why = reasons[i] if reasons[i] != "end?" else "end" if s[-1][4] else "none"
            n_late = sum(1 for c in all_ if c[3] and s[0][0] <= c[0] < until)
            out.append((client, s[0][1], s[0][0], s[-1][0], len(s), n_late, sum(c[5] for c in s), why, hashlib.sha256(",".join(str(c[1]) for c in s).encode()).hexdigest()))
    return sorted(out)


NAMES = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "{}", 1, "x", 2) for r in rows], SCHEMA).repartition(parts)


def got(df):
    return sorted(tuple(r) for r in session_digests(df).select(*NAMES).collect())


def stream(r, client, n, mean_s, ids, final=0.0, late=0.05, at=START):
    rows = []
    for _ in range(n):
        at = at + timedelta(seconds=r.choice([0, 0, 1, 1, 1, 1, 2]) * r.expovariate(1 / mean_s))
        kind = "purchase" if r.random() < final else r.choice(["view", "click", None])
        delay = timedelta(minutes=40) if r.random() < late else timedelta(seconds=r.randint(0, 900))
        rows.append((next(ids), at, at + delay, client, kind, r.choice([None, 60.0, 75.125, 3.3])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_the_contract(spark, seed):
    r, ids = random.Random(seed), iter(range(1, 100_000))
    rows = stream(r, 1, 300, 240, ids, 0.05) + stream(r, 2, 200, 1500, ids, 0.1, 0.3)
    rows += stream(r, 3, 400, 400, ids)  # days without a final, some gaps
    rows += [(9000 + i, START + timedelta(hours=i), None, 4, "view", 1.0) for i in range(30)]
    rows += [(9100 + i, START + timedelta(minutes=60 * i), START, 5, "signup" if i % 2 else "view", 99.0) for i in range(10)]
    rows += rows[:80]  # repeated
    assert got(frame(spark, rows)) == plain(rows)


def test_days_without_a_break_are_composed_over_blocks(spark, monkeypatch):
    """A client that never pauses: every block is run through, so its sessions depend on the first click."""
    r, ids = random.Random(9), iter(range(1, 100_000))
    rows = [(next(ids), START + timedelta(minutes=7 * i + r.random() * 5), START, 1, "view", 1.5) for i in range(900)]
    rows += [(next(ids), START + timedelta(days=9, minutes=5 * i + r.random() * 4), START, 1, "view", 1.5) for i in range(500)]
    rows += [(next(ids), START + timedelta(minutes=11 * i), START + timedelta(days=i % 9 == 0), 2, "purchase" if i == 700 else "view", 61.0) for i in range(1000)]
    rows += [(next(ids), START + timedelta(minutes=3 * i), START + timedelta(days=90), 3, "view", 1.0) for i in range(50)]  # only late ones
    want = plain(rows)
    assert got(frame(spark, rows)) == want
    assert sum(w[7] == "length" for w in want) > 200


def test_borders_of_blocks(spark):
    day = START + timedelta(hours=6)
    near = lambda m, s=0: day + timedelta(minutes=m, seconds=s)
    rows = [(1, near(-70), START, 1, "view", 1.0), (2, near(-60), START, 1, "view", 1.0)]
    rows += [(3 + i, near(-50 + 10 * i), START, 1, "view", 1.0) for i in range(12)]
    rows += [(50, near(-1), START, 2, "signup", 80.0), (51, near(1), START, 2, "view", 1.0)]  # a final click just before the border
    rows += [(60, near(-15), START, 3, "view", 1.0), (61, near(0), START, 3, "view", 1.0)]  # exactly the gap
    rows += [(70, near(-14, 1), START, 4, "view", 1.0), (71, near(0), START, 4, "view", 1.0)]
    # the open session is too long for the next block's first click
    rows += [(80 + i, near(-61 + 12 * i), START, 5, "view", 1.0) for i in range(6)] + [(90, near(0, 1), START, 5, "view", 1.0)]
    rows += [(100, near(3), near(90), 5, "view", 9.0), (101, near(-600), near(90), 5, "view", 9.0), (102, near(9000), near(90000), 5, "view", 9.0)]
    # several sessions of one time: each click is final
    rows += [(110 + i, near(0), START, 6, "purchase", 60.0) for i in range(3)] + [(120, near(0), near(500), 6, "view", None)]
    rows += [(130, datetime(1969, 12, 31, 23, 59, 50), START, 7, "view", 1.0), (131, datetime(1970, 1, 1, 0, 0, 3), START, 7, "view", -1.0)]
    assert got(frame(spark, rows)) == plain(rows)


def test_defined_cases(spark):
    assert session_digests(frame(spark, []).limit(0)).collect() == []
    at = START
    rows = [(1, at, at, None, "view", 1.0), (2, None, at, 1, "view", 1.0), (3, at, None, 1, None, None), (None, at, at, 2, "purchase", float("nan")), (None, at, at, 2, "purchase", float("nan")), (5, at, at, 3, "signup", float("inf"))]
    out = {r.client_id: r for r in session_digests(frame(spark, rows)).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].session_id == 3 and out[1].n_clicks == 1
    assert out[2].session_id is None and out[2].n_clicks == 1 and out[2].value_cents == 0 and out[2].closed_by == "none"
    assert out[3].value_cents == 0 and out[3].closed_by == "none"
    # copies that differ: the least by time counts
    differ = [(1, at + timedelta(minutes=m), at, 1, "view", 1.0) for m in (9, 3, 5)]
    assert [r.start_us for r in session_digests(frame(spark, differ)).collect()] == [plain(differ)[0][2]]


def test_own_limits_and_paths(spark):
    rows = [(i, START + timedelta(minutes=4 * i), START, 1, "view", 1.0) for i in range(40)]
    out = sorted(sessions(frame(spark, rows), gap_minutes=5, length_minutes=20, final=F.col("click_id") == 3).collect(), key=lambda r: r.start_us)
    assert [r.path for r in out][:3] == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9], [10, 11, 12, 13, 14, 15]] and out[0].closed_by == "end"
    with pytest.raises(ValueError):
        sessions(frame(spark, rows), gap_minutes=1, length_minutes=60)


def test_zone_of_the_session_does_not_matter(spark):
    rows = [(i, START + timedelta(days=70, minutes=9 * i), START, 1, "view", 1.0) for i in range(20)]
    want = plain(rows)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert got(frame(spark, rows)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_single_task_and_islands_by_cells(spark):
    timely = spark.createDataFrame([(1, i * 10 * MINUTE, i, 0, False) for i in range(100)] + [(1, 2000 * MINUTE, 200, 0, False)], "client long, us long, id long, cents long, final boolean")
    found = sorted(s for r in module.island_starts(timely, 15 * MINUTE).collect() for s in r.starts)
    assert found == [0, 2000 * MINUTE]
    plan = module.pieces(timely, module.island_starts(timely, 15 * MINUTE), 15 * MINUTE)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(client" in plan and "windowspecdefinition(us" not in plan
