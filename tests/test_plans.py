from pyspark.sql import functions as F

from tallyforge.operators import listing
from tallyforge.plans import api, build, live


def test_live_run(spark):
    cells = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = lambda html, url="u": spark.createDataFrame([(url, html)], "url string, html string")
    state = page(cells("North Hill", 9, "Ann", "A", "Bob", "B", "200", "9/9", "Result Declared") + cells("Old Spelling", 2, "Cy", "C", "Di", "D", "10", "1/9", "in progress"))
    cards = page("<div class='cand-box'><div class='status won'><div>w</div><div>600</div></div><h5>Ann</h5><h6>A</h6></div><div class='cand-box'><div class='status lost'><div>l</div><div>350</div></div><h5>Bob</h5><h6>B</h6></div>", "page-9.htm")
    party = page(cells("1", "Old Spelling(2)", "Cy", "100", "10", "s"))
    contests = spark.createDataFrame([("c1", "northhill", 1), ("c2", "newspelling", 5)], "id string, key string, number int")
    docs = live.contest_documents(state, cards, party, contests, {"oldspelling": "newspelling"})
    got = {r.id: (r.leader, r.margin, r.total, r.declared) for r in docs.collect()}
    assert got == {"c1": ("Ann", 250, 950, True), "c2": ("Cy", 10, 190, False)}
    summary, status = live.run(docs, spark.createDataFrame([], "id string, declared_at string"), F.lit("now"))
    assert summary.first().declared == 1 and status.first().status == "ok"


def test_build(spark):
    raw = spark.createDataFrame([("1", "Ann Roy", "c1", 40), ("2", "Bob", "c2", 50)], "id string, name string, contest string, age int")
    changes = spark.createDataFrame([("2", "age", "51")], "id string, field string, value string")
    winners = spark.createDataFrame([("Twin (SC)", "East", "ROY ANN"), ("Twin", "West", "Bob")], "ac_name string, district string, winner string")
    contests = spark.createDataFrame([("c1", "Twin", "East"), ("c2", "Twin", "West")], "id string, name string, district string")
    got = build.candidates(raw, changes, ["age"], winners, contests, {}).orderBy("id").collect()
    assert [(r.age, r.incumbent) for r in got] == [(40, True), (51, True)]
    rows = [(2021, 1, 1, "Ann", 60), (2021, 1, 2, "NOTA", 50), (2021, 1, 3, "Bob", 40)]
    h = build.history(spark.createDataFrame(rows, "year int, ac_number int, position int, candidate string, votes long"), spark.createDataFrame([], "year int, ac_number int, position int, candidate string, votes long"), spark.createDataFrame([(2021, 1, 1, "X", 1)], "year int, ac_number int, position int, candidate string, votes long"), 2021).first()
    assert (h.winner, h.runner_up, h.margin_votes, h.total_votes, h.margin_pct) == ("Ann", "Bob", 20, 150, 13.33)


def test_api(spark):
    people = spark.createDataFrame([("1", "Ann", "A", "c1"), ("2", "Bob", "Z", "c1")], "id string, name string, party string, contest string")
    parties = spark.createDataFrame([("A", "Alpha")], "id string, name string")
    contests = spark.createDataFrame([("c1", "North", "উত্তর", "E")], "id string, name string, name_bn string, district string")
    assert [r.total for r in api.candidates(people, parties, contests, party="A").collect()] == [1]
    assert api.candidate(people, parties, contests, "2").first().party_info is None
    assert [api.contests(contests, q).count() for q in ("nor", "উত্তর", "x", "")] == [1, 1, 0, 1]


def test_codec_and_sets(spark):
    df = spark.range(1).select(listing.encoded(F.array(F.struct(F.lit("a b").alias("q")))).alias("t"))
    assert df.select(listing.decoded(F.col("t"), "array<struct<q:string>>")[0]["q"]).first()[0] == "a b"
    assert spark.range(1).select(listing.decoded(F.lit("%zz"), "array<string>")).first()[0] is None
    assert listing.without(spark.range(4), [1, 2]).count() == 2


def test_quartile_cuts_are_exact_whatever_the_ranges_hold(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tallyforge.operators import contest

    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 10**9, 5000).tolist(), [7] * 900 + list(range(100)), [5], rng.integers(0, 3, 1000).tolist()):
        row = contest.quartile_cuts(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double"), "x").first()
        assert list(row) == [sorted(values)[int(len(values) * q)] for q in (0.25, 0.5, 0.75)]
    shares = spark.createDataFrame([(p, v, v / 10) for p, v in (("a", 500), ("b", 300), ("c", 100), ("d", 60), ("e", 25), ("f", 10), ("g", 5))], "party string, votes long, share double")
    assert {r.party: r.votes for r in contest.others_collapsed(shares, "party", "votes", "share").collect()} == {"a": 500, "b": 300, "c": 100, "d": 60, "e": 25, "Others": 15}
