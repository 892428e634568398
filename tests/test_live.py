import datetime as dt
import random

from pyspark.sql import functions as F

from tallyforge import bindings
from tallyforge.operators import keys, live, matching, people
from tallyforge.streaming.live import first_seen, first_seen_state, landed, latest_state, pages_until_failure, run_available, upsert_latest


def test_documents(spark):
    state = spark.createDataFrame([("a", 1, "Ann", "A", "Bob", "B", 50, False), ("b", 2, "Cy", "C", "", None, 7, True), ("c", 3, "", None, "", None, 0, False), (None, 4, "X", "Y", "", None, 1, False)], "id string, ac_number int, lead string, lead_party string, trail string, trail_party string, margin long, declared boolean")
    details = spark.createDataFrame([(1, 1, "Bob", "B", 400, "lost"), (1, 2, "Ann", "A", 600, "won")], "ac_number int, ord int, name string, party string, votes long, status string")
    party = spark.createDataFrame([(2, "CY.", 100)], "ac_number int, lead string, votes long")
    got = {r.id: r for r in live.documents(state, details, party).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].leader, got["a"].margin, got["a"].total, got["a"].declared) == ("Ann", 200, 1000, True)
    assert (got["b"].leader, got["b"].margin, got["b"].total, len(got["b"].contestants)) == ("Cy", 7, 193, 1) or got["b"].total == 100
    s = live.summary(live.documents(state, details, party), spark.createDataFrame([("a", "t0")], "id string, declared_at string"), F.lit("t1")).first()
    assert (s.contests, s.declared, [w.declared_at for w in s.winners], [t.margin for t in s.tightest]) == (2, 2, ["t1", "t0"], [7, 200])


def test_checked(spark):
    u = spark.createDataFrame([("a", [("x", 1)]), ("z", [("x", 1)]), ("b", []), ("b", [("x", None)])], "id string, contestants array<struct<name:string,votes:long>>")
    got = [r.reason for r in live.checked(u, spark.createDataFrame([("a",), ("b",)], "id string")).collect()]
    assert sorted(map(str, got)) == ["None", "no contestants", "no valid contestant", "unknown contest"]


def test_first_and_last(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, ord int, v string")
    assert [keys.keep_one(df, ["key"], "ord", k).first().v for k in ("first", "last")] == ["a", "b"]
    assert [r.v for r in people.by_ids(df, [2, 9, 1], "ord").collect()] == ["b", "a"]


def test_ranked_over_ranges(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).cast("double").alias("v"))
    want = sorted(((r.v, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    got = {r.id: r.place for r in keys.ranked(df, "v", "id", "place", parts=8).collect()}
    assert [got[i] for _, i in want] == list(range(1, 1001))


def test_token_match(spark):
    w = spark.createDataFrame([("a", "Roy, Ann"), ("a", "বাংলা"), ("b", "Ann Roy")], "ac string, who string")
    p = spark.createDataFrame([("a", "Ann B Roy", 2), ("a", "ROY ANN", 3), ("b", "Cy", 1)], "ac string, name string, ord int")
    got = matching.token_match(w, p, "ac", "who", "name", "ord").collect()
    assert [(r.who, r.match.ord, r["pass"]) for r in got] == [("Roy, Ann", 3, 1)]


def test_token_match_of_every_row(spark):
    rng = random.Random(3)
    name = lambda: " ".join(rng.choice("ABCDEFG") for _ in range(rng.randint(0, 4)))
    wanted, pool = ([(rng.choice("xy"), name(), i) for i in range(300)] for _ in range(2))
    w, p = spark.createDataFrame(wanted, "ac string, who string, n int"), spark.createDataFrame(pool, "ac string, name string, ord int")
    # Rows that are equal in all columns are matched one by one.
    got = matching.token_match(w.union(w), p, "ac", "who", "name", "ord").collect()
    want = []
    for ac, who, n in wanted:
        own, fits = who.split(), []
        for g, other, o in pool:
            short, long = sorted((own, other.split()), key=len) if len(own) > len(other.split()) else (own, other.split())
            if g == ac and own and other and set(short) <= set(long):
                fits.append((1 if own == other.split() else 2, o))
        want += [(n, *min(fits))] * 2 if fits else []
    assert sorted((r.n, r["pass"], r.match.ord) for r in got) == sorted(want) and {x[1] for x in want} == {1, 2}


def test_bound_matches_leave_nothing_out(spark, sf):
    part, events = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/events.parquet")
    got = bindings.QUERIES["fuzzy_match_all"](spark, sf)
    # A name holds its own tokens, so each has a match.
    assert got.count() == part.count() == got.select("wid").distinct().count()
    now = bindings.QUERIES["declared_vs_leading_all"](spark, sf)
    gone = {r.user_id for r in events.select("user_id").distinct().collect()} - {r.key for r in now.collect()}
    assert gone <= set(bindings.ON_HOLD)


def test_on_hold_is_a_list_of_keys(spark):
    now = spark.createDataFrame([(10, True), (20, False), (152, False), (153, True)], "key long, declared boolean")
    got = live.declared_and_leading(now, "key", "declared", spark.createDataFrame([(152,), (153,)], "key long")).collect()
    assert sorted((r.key, r.state) for r in got) == [(10, "declared"), (20, "leading"), (153, "declared")]


def test_gaps_are_no_array(spark):
    # Far more ids than one array can hold; the join's own work is left out.
    ids = spark.createDataFrame([(3_000_000_000,), (2,)], "id long")
    assert matching.gaps(ids, "id", first=2_999_999_990).count() == 60
    far = matching.gaps(ids, "id")
    assert "explode" not in far._jdf.queryExecution().toString() and "Range (1, 3000000051" in far._jdf.queryExecution().toString()
    assert [matching.gaps(ids.limit(0), "id", beyond=n).count() for n in (0, 3)] == [0, 3]


def test_summary_takes_ten_and_has_rows(spark):
    docs = spark.range(1, 41).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("leader"), F.lit("p").alias("leader_party"), (41 - F.col("id")).alias("margin"), (F.col("id") < 3).alias("declared"))
    before = spark.createDataFrame([("1", "t0")], "id string, declared_at string")
    s = live.summary(docs, before, F.lit("t1"))
    assert [t.margin for t in s.first().tightest] == list(range(1, 11)) and len(s.first().leader_by_contest) == 40
    assert {r.id: r.declared_at for r in live.summary_rows(docs, before, F.lit("t1")).where("declared").collect()} == {"1": "t0", "2": "t1"}
    assert s.columns == ["contests", "declared", "leader_by_contest", "tightest", "leader_name", "margin_by_contest", "winners"]


def test_priority_and_fan_out(spark):
    s = lambda *rows: spark.createDataFrame(rows, "year int, v string")
    got = matching.by_priority([s((2016, "a")), s((2016, "b"), (2021, "b")), s((2021, "c"))], "year").collect()
    assert sorted(tuple(r) for r in got) == [(2016, "a"), (2021, "b")]
    c = spark.createDataFrame([("1", "E"), ("2", "W"), ("3", "?")], "id string, district string")
    d = spark.createDataFrame([("E", 70.0, None), ("W", 60.0, "E")], "district string, lit double, proxy string")
    o = spark.createDataFrame([("1", 99.0)], "id string, lit double")
    assert sorted((r.id, r.lit, r.note) for r in matching.fanned_out(c, d, o, "id", "district", ["lit"]).collect()) == [("1", 99.0, None), ("2", 60.0, "figures of E"), ("3", None, "no district figures")]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", 1, at(1), True), ("a", 2, at(2), False), ("b", 3, at(3), True), ("a", 4, at(4), True), ("b", 5, at(5), True), ("a", 6, at(6), True)]
    schema = "key string, id long, ts timestamp, declared boolean"
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = landed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    last = latest_state(spark, str(tmp_path / "last"), schema, "key", "ts", "id")
    run_available(stream, str(tmp_path / "c1"), upsert_latest(last, "ts", "id"))
    every = spark.createDataFrame(rows, schema)
    assert sorted(last.read().collect()) == sorted(live.latest(every, "key", "ts", "id").collect())
    seen = first_seen_state(spark, str(tmp_path / "seen"), "key", "string", "timestamp", "long")
    run_available(stream, str(tmp_path / "c2"), first_seen(seen, "ts", "declared", "id"))
    assert {r.key: r.declared_at for r in seen.read().collect()} == {"a": at(4), "b": at(3)}
    last.drop_keys(spark.createDataFrame([("a",)], "key string"))
    assert [r.key for r in last.read().collect()] == ["b"]
    last.reset()
    assert last.read().count() == 0


def test_pages_until_failure(spark):
    pages = [("a", 1, 200), ("a", 2, 200), ("a", 3, 404), ("a", 4, 200), ("b", 1, 200), ("b", 3, 200), ("c", 1, None), (None, 1, 200), ("d", 1, 200), ("d", 1, 200), ("d", 2, 200)]
    got = pages_until_failure(spark.createDataFrame(pages, "run string, page int, status int")).collect()
    assert sorted((r.run or "", r.page) for r in got) == [("", 1), ("a", 1), ("a", 2), ("b", 1), ("d", 1), ("d", 1), ("d", 2)]
    many = spark.range(1, 41).select(F.lit("x").alias("run"), F.col("id").alias("page"), F.lit(200).alias("status"))
    assert pages_until_failure(many).count() == 20 and pages_until_failure(many.limit(0)).count() == 0


def test_phase_gate(spark):
    assert [live.gated(spark.range(2), p).count() for p in ("LIVE ", "post", None)] == [2, 0, 0]
