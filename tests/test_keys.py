"""Places and medians of groups against plain Python, with a group of most rows, ties, nulls and an empty table."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import keys, live
from tallyforge.sources import keyed

SCHEMA = "g string, v long, id long"


@pytest.fixture(params=[False, True], ids=["small", "large"])
def groups(request, monkeypatch):
    """Every test with groups that one task sorts and with groups that are spread over ranges."""
    if request.param:
        monkeypatch.setattr(keys, "SMALL", 50)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [("hot", rng.choice([7, rng.randrange(500)]), i) for i in range(700)]
    return hot + [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(40)]), i) for i in range(700, 900)] + [("none", None, 900)]


@pytest.mark.usefixtures("groups")
def test_medians(spark, rows):
    got = {r.g: r.median for r in keys.medians(spark.createDataFrame(rows, SCHEMA), ["g"], "v", 16).collect()}
    own = {}
    for g, v, _ in rows:
        if v is not None:
            own.setdefault(g, []).append(v)
    assert got == {g: float(median(vs)) for g, vs in own.items()}


@pytest.mark.usefixtures("groups")
def test_placed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("v is not null")
    got = {r.id: r.place for r in keys.placed(df, ["g"], -F.col("v").cast("double"), [F.desc("v"), F.col("id")], parts=16).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: i for i, r in enumerate(own, 1)}
    assert got == want


@pytest.mark.usefixtures("groups")
def test_nth_event(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("v is not null")
    got = {r.g: r.id for r in live.nth_event(df, "g", "v", "id", 30).collect()}
    own = {g: sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None) for g in {r[0] for r in rows}}
    assert got == {g: vs[29][1] for g, vs in own.items() if len(vs) >= 30}


@pytest.mark.usefixtures("groups")
def test_cumulated(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("v is not null")
    got = {r.id: r.upto for r in keys.cumulated(df, ["g"], F.col("v").cast("double"), [F.col("v"), F.col("id")], F.col("id") % 3, "upto", parts=16).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (r[1], r[2])):
            total += r[2] % 3
            want[r[2]] = total
    assert got == want


@pytest.mark.usefixtures("groups")
def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keys.medians(df, ["g"], "v").count() == keys.placed(df, ["g"], F.col("v").cast("double"), [F.col("v")]).count() == 0


@pytest.mark.parametrize("stored", [False, True])
def test_places_with_nulls_and_ties(spark, tmp_path, stored):
    rows = [(None if i % 9 == 0 else i % 7, i) for i in range(400)] + [(3, i) for i in range(400, 900)]
    df = spark.createDataFrame(rows, "v long, id long")
    if stored:
        df.write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    got = {r.id: r.place for r in keys.ranked(df, "v", "id", "place", parts=16).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r[1]: n for n, r in enumerate(want, 1)}
    # Rows of one value are spread: places come from the whole order.
    assert keys._sorted(df.where("v = 3"), [F.desc("v"), F.asc("id")], 8).select("_part").distinct().count() > 4
    assert keys.ranked(df.limit(0), "v", "id").count() == 0


def test_running_sums(spark):
    rows = [(i % 5 if i % 11 else None, i) for i in range(300)]
    got = {r.id: r.before for r in keys.running(spark.createDataFrame(rows, "v long, id long"), [F.desc_nulls_last("v"), F.asc("id")], "v", "before", 8).collect()}
    total, want = 0, {}
    for v, i in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        want[i] = total
        total += v or 0
    assert got == want


def test_pages_of_a_sorted_table(spark, tmp_path):
    df = spark.range(2000).select("id", (F.col("id") * 7 % 100).alias("v"))
    keyed.write_sorted(df, str(tmp_path / "t"), [F.desc("v"), F.asc("id")], 20)
    want = [tuple(r) for r in df.orderBy(F.desc("v"), "id").collect()]
    for number, size in ((1, 30), (2, 30), (67, 30), (68, 30), (1, 5000), (4, 500)):
        page = keyed.page(spark, str(tmp_path / "t"), number, size)
        assert [tuple(r) for r in page.collect()] == want[(number - 1) * size : number * size]
        # The first and the last page read as little: the ranges that hold them.
        assert size > 30 or len(page.inputFiles()) <= 2
    keyed.write_sorted(df.limit(0), str(tmp_path / "none"), [F.asc("v")], 4)
    assert keyed.page(spark, str(tmp_path / "none"), 1, 10).count() == 0


def test_keys_are_read_from_one_file(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    keyed.write(df, str(tmp_path / "t"), "key", 32)
    one = keyed.read(spark, str(tmp_path / "t"), "key", ["k77"])
    assert [r.id for r in one.collect()] == [77] and len(one.inputFiles()) == 1
    assert sorted(r.id for r in keyed.read(spark, str(tmp_path / "t"), "key", ["k1", "k4999", "none"]).collect()) == [1, 4999]


def test_policies_hold_for_readers(spark):
    keyed.publish(spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_active boolean"), "open_rows", F.col("is_active"))
    assert [r.id for r in spark.sql("SELECT id FROM open_rows").collect()] == [1]
