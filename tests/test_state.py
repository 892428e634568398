"""Keyed state: commits, replays, several writers, deletions that last, ends of rows, patches, changes and totals."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import live
from tallyforge.streaming.live import Summary, latest_state, upsert_latest
from tallyforge.streaming.state import State

SCHEMA = "key long, at long, v string"


@pytest.fixture
def state(spark, tmp_path):
    return latest_state(spark, str(tmp_path / "state"), SCHEMA, "key", "at", "v", buckets=4)


def frame(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame(list(rows), schema)


def held(state, version=None):
    return {r[0]: r[-1] for r in state.read(version).collect()}


def folders(state):
    return [s.getPath().getName() for s in state.files.listStatus(state._path("")) if s.getPath().getName()[:2] in ("b-", "d-")]


def test_deleted_keys_stay_deleted(spark, state):
    land = upsert_latest(state, "at", "v")
    land(frame(spark, (1, 1, "a"), (2, 1, "b")), 0)
    state.drop_keys(frame(spark, (1, 0, "")))
    land(frame(spark, (3, 1, "c")), 1)
    assert held(state) == {2: "b", 3: "c"}
    # A key that is put again starts anew, even with an earlier time; a late row of another key doesn't win by that.
    land(frame(spark, (1, 0, "again"), (2, 0, "late")), 2)
    assert held(state) == {1: "again", 2: "b", 3: "c"}
    state.reset()
    land(frame(spark, (9, 0, "x")), 3)
    assert held(state) == {9: "x"}


def test_a_batch_lands_once(spark, state):
    land = upsert_latest(state, "at", "v")
    land(frame(spark, (1, 1, "a")), 0)
    land(frame(spark, (1, 2, "b")), 1)
    before = (state.versions(), folders(state))
    land(frame(spark, (1, 9, "other")), 1)
    land(frame(spark, (1, 9, "other")), 0)
    assert held(state) == {1: "b"} and (state.versions(), sorted(folders(state))) == (before[0], sorted(before[1]))
    # The batches of another source have numbers of their own; an empty batch lands nothing.
    upsert_latest(state, "at", "v", source="hand")(frame(spark, (2, 1, "c")), 0)
    land(frame(spark), 2)
    assert held(state) == {1: "b", 2: "c"}


def test_writers_at_once_lose_no_row(spark, state):
    def writer(i):
        own = latest_state(spark, state.folder, SCHEMA, "key", "at", "v", buckets=4)
        for n in range(3):
            upsert_latest(own, "at", "v", source=f"w{i}")(frame(spark, (10 * i + n, 1, f"{i}/{n}"), (100, 10 * n + i, "shared")), n)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(writer, range(4)))
    assert held(state) == {10 * i + n: f"{i}/{n}" for i in range(4) for n in range(3)} | {100: "shared"}
    assert state.read().where("key = 100").first().at == 23
    assert state.versions() == list(range(1, len(state.versions()) + 1))


def test_a_number_is_put_once(spark, tmp_path):
    """Writers that find a number free at the same moment: one of them lands, and what it wrote stays."""
    writers, gate = [State(spark, str(tmp_path / "s"), SCHEMA) for _ in range(6)], Barrier(6)

    def put(i, number):
        gate.wait()
        return writers[i]._landed({"version": number, "by": i})

    with ThreadPoolExecutor(6) as pool:
        for number in range(1, 41):
            landed = list(pool.map(put, range(6), [number] * 6))
            assert sum(landed) == 1 and writers[0].snapshot(number)["by"] == landed.index(True)
    assert not [n for s in writers[0].files.listStatus(writers[0]._path("_log")) if (n := s.getPath().getName()).startswith(".")]


def test_fifty_batches_against_plain(spark, tmp_path):
    rng = random.Random(4)
    state = latest_state(spark, str(tmp_path / "s"), SCHEMA, "key", "at", "v", buckets=2)
    land, want, most, written = upsert_latest(state, "at", "v"), {}, 0, 0
    for n in range(50):
        rows = [(rng.randrange(40), rng.randrange(1000), f"{n}.{i}") for i in range(rng.randint(1, 12))]
        gone = sorted(set(rng.choices(range(40), k=2))) if n % 7 == 3 else []
        if gone:
            state.drop_keys(frame(spark, *[(k, 0, "") for k in gone]))
            want = {k: v for k, v in want.items() if k not in gone}
        land(frame(spark, *rows), n)
        for k, at, v in rows:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        most = max(most, len(folders(state)))
        if n % 16 == 0:
            assert held(state) == {k: v for k, (_, v) in want.items()}, n
    assert held(state) == {k: v for k, (_, v) in want.items()}
    # Folders of the last few commits, and no more however many have been.
    assert most < 40 and state.snapshot()["base"] and len(state.snapshot()["deltas"]) < 8


def test_what_is_written_follows_the_batch(spark, tmp_path):
    state = latest_state(spark, str(tmp_path / "s"), SCHEMA, "key", "at", "v", buckets=2)
    land = upsert_latest(state, "at", "v")
    land(spark.range(20000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("at"), F.lit("x").alias("v")), 0)
    for n in range(1, 12):
        land(frame(spark, (n, 2, "y")), n)
    # No commit since the first has written the large part again.
    assert sum(d["rows"] for d in state.snapshot()["deltas"]) == 20011 and state.snapshot()["base"] is None or state.snapshot()["base"]["rows"] == 20000
    assert state.read().where("v = 'y'").count() == 11 and state.read().count() == 20000
    files = state.get(5)._jdf.queryExecution().optimizedPlan().toString()
    assert [r.v for r in state.get(5).collect()] == ["y"] and "_bucket" in files


def test_rows_end_by_the_clock_of_the_data(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    state = latest_state(spark, str(tmp_path / "s"), "key long, at timestamp, until timestamp, v string", "key", "at", "v", until="until")
    put = lambda n, *rows: upsert_latest(state, "at", "v")(spark.createDataFrame([(k, at(a), None if u is None else at(u), v) for k, a, u, v in rows], "key long, at timestamp, until timestamp, v string"), n)
    put(0, (1, 1, 10, "a"), (2, 1, None, "b"), (3, 2, 30, "c"))
    assert held(state) == {1: "a", 2: "b", 3: "c"}
    put(1, (4, 10, 40, "d"))
    assert held(state) == {2: "b", 3: "c", 4: "d"}
    # A row that is over no longer wins over an earlier one.
    put(2, (1, 0, 50, "late"))
    assert held(state) == {1: "late", 2: "b", 3: "c", 4: "d"}
    for n in range(3, 14):
        put(n, (4, 10 + n, 59, "d"))
    put(14, (5, 45, 59, "e"))
    assert held(state) == {1: "late", 2: "b", 4: "d", 5: "e"} and state.snapshot()["base"] is not None


def test_patches_set_columns_in_place(spark, state):
    upsert_latest(state, "at", "v")(frame(spark, (1, 5, "a"), (2, 5, "b")), 0)
    state.patch(frame(spark, (1, "new"), (7, "none"), schema="key long, v string"))
    assert held(state) == {1: "new", 2: "b"}
    upsert_latest(state, "at", "v")(frame(spark, (1, 4, "older"), (2, 6, "newer")), 1)
    assert held(state) == {1: "new", 2: "newer"}


def test_changes_and_earlier_versions(spark, state):
    upsert_latest(state, "at", "v")(frame(spark, (1, 1, "a"), (2, 1, "b")), 0)
    upsert_latest(state, "at", "v")(frame(spark, (2, 2, "c"), (3, 1, "d"), (1, 0, "late")), 1)
    version = state.version_of("stream", 1)
    got = {r.key: (r.old and r.old.v, r.new.v) for r in state.changes(version).collect()}
    assert got == {1: ("a", "a"), 2: ("b", "c"), 3: (None, "d")}
    assert held(state, version - 1) == {1: "a", 2: "b"} and state.version_of("stream", 7) is None


def test_a_slow_writer_takes_no_old_number(spark, state, monkeypatch):
    from tallyforge.streaming import state as module

    monkeypatch.setattr(module, "LOGGED", 3)
    for n in range(6):
        upsert_latest(state, "at", "v")(frame(spark, (n, 1, "a")), n)
    assert min(state.versions()) > 1
    assert not state._landed(state.snapshot() | {"version": 1}) and 1 not in state.versions()


def test_states_with_any_merge(spark, tmp_path):
    add = lambda old, new: F.struct(old["key"].alias("key"), (old["n"] + new["n"]).alias("n"))
    state = State(spark, str(tmp_path / "s"), "key string, n long", merge=add)
    for i in range(12):
        state.commit(spark.createDataFrame([("a", 1), (f"k{i % 3}", i), (None, 5)], "key string, n long"))
    assert held(state) == {"a": 12, "k0": 18, "k1": 22, "k2": 26}


def test_totals_follow_every_change(spark, tmp_path):
    rng = random.Random(8)
    schema = "key long, at long, party string, votes long, margin long, declared boolean"
    state = latest_state(spark, str(tmp_path / "s"), schema, "key", "at", "party", buckets=2)
    sums = {"declared": lambda r: r["declared"].cast("long"), "votes": lambda r: r["votes"]}
    summary = Summary(state, str(tmp_path / "t"), "party", sums, "margin", lambda r: r["margin"] > 0, k=3, spare=2)
    for n in range(8):
        if n % 4 == 3:
            version = state.drop_keys(state.read().orderBy("margin").limit(4))
        else:
            rows = [(rng.randrange(25), n, rng.choice("ABC"), rng.randrange(100), rng.randrange(60), rng.random() < 0.4) for _ in range(rng.randint(1, 9))]
            upsert_latest(state, "at", "party")(spark.createDataFrame(rows, schema), n)
            version = state.version_of("stream", n)
            run = {r.party: r.contests for r in summary.of_run(version).collect()}
            assert sum(run.values()) == len({r[0] for r in rows})
        summary.update(version)
        if n == 2:
            summary.update(version)
        now = state.read()
        want = now.groupBy("party").agg(F.count("*").alias("contests"), F.count_if("declared").alias("declared"), F.sum("votes").alias("votes"))
        assert sorted(summary.read().collect()) == sorted(want.collect()), n
        assert summary.tightest() == [(r.margin, r.key) for r in live.tightest(now, 3, tie="key").collect()], n
    summary.update(state.reset())
    assert summary.read().count() == 0 and summary.tightest() == []
