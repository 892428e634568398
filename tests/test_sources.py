from pyspark.sql import functions as F

from tallyforge.sources import files, pages, reports, synthetic


def page(spark, html):
    return spark.createDataFrame([("u", html)], "url string, html string")


def test_statewise_with_nested_table(spark):
    row = "<tr><td>North</td><td>12</td><td>Ann</td><td><table><tr><td>Party A</td><td>i</td></tr></table></td><td>Bob</td><td>Party B</td><td>1,234</td><td>3/9</td><td>Result Declared</td></tr>"
    bad = "<tr><td>x</td><td>999</td>" + "<td>y</td>" * 7 + "</tr><tr><td>short</td></tr>"
    got = pages.statewise(page(spark, f"<table>{row}{bad}</table>")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.ac_number, r.ac_name, r.lead_party, r.margin, r.round, r.rounds, r.declared) == (12, "North", "Party A", 1234, 3, 9, True)


def test_statewise_tables_of_any_depth(spark):
    def cell(depth):
        return f"<td>Deep {depth}</td>" if depth == 0 else f"<td> <table class='t{depth}'><tr>{cell(depth - 1)}<td>i</td></tr></table> </td>"

    rows = "".join(f"<tr><td>North {n}</td><td>{n}</td><td>Ann</td>{cell(n - 1)}<td>Bob</td><td>B</td><td>1</td><td>3/9</td><td>x</td></tr>" for n in range(1, 9))
    got = pages.statewise(page(spark, f"<table>{rows}</table>")).orderBy("ac_number").collect()
    assert [(r.ac_number, r.lead_party) for r in got] == [(n, "Deep 0") for n in range(1, 9)]
    assert pages.statewise(page(spark, "</table></table><table>")).count() == pages.statewise(page(spark, None)).count() == 0


def test_cards(spark):
    card = "<div class='cand-box'><div class='status {s}'><div>{s}</div><div>{v} (+ 5)</div></div><h5>{n}</h5><h6>{p}</h6></div>"
    got = pages.cards(page(spark, "x" + card.format(s="won", v="1,200", n="Ann", p="A") + card.format(s="lost", v="900", n="Bob", p="B") + "<div class='cand-box'><h5>NOTA</h5></div>")).orderBy("ord").collect()
    assert [(r.name, r.party, r.status, r.votes, r.declared) for r in got] == [("Ann", "A", "won", 1200, True), ("Bob", "B", "lost", 900, True)]


def test_partywise_and_ids(spark):
    html = "<tr><td>1</td><td>North(12)</td><td>Ann</td><td>1,000</td><td>5</td><td>s</td></tr><tr><td>S.No</td><td>x</td><td></td><td></td><td></td><td></td></tr> partywiselead-140S.htm partywiselead-7S.htm partywiselead-140S.htm"
    assert [tuple(r)[2:] for r in pages.partywise(page(spark, html)).collect()] == [(12, "Ann", 1000)]
    assert sorted(r.id for r in pages.linked_ids(page(spark, html), r"partywiselead-(\d+)S").collect()) == ["140", "7"]


def test_best_table(spark):
    t = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    html = t(("menu", "a", "b")) + t(("Ann", "A", "600", "60"), ("Bob", "B", "400", "")) + t(("x", "y", "70"), ("z", "w", "80"))
    got = {r.name: (r.party, r.votes, r.share) for r in pages.best_table(page(spark, html)).collect()}
    assert got == {"Ann": ("A", 600, 60.0), "Bob": ("B", 400, 40.0)}
    assert pages.best_table(page(spark, "No result yet")).count() == 0


def test_best_table_stays_in_its_row(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = "<table>" + row("Ann", "A", "600", "") + row("x", "y") + row("Bob", "B", "300", "") + "</table><table>" + row("C", "c", "70") + row("D", "d", "80") + "</table>"
    got = pages.best_table(page(spark, html))
    # The first of two equal tables, places counted over all rows of it; no page's rows are shuffled.
    assert [(r.row, r.name, r.votes, round(r.share, 2)) for r in got.collect()] == [(0, "Ann", 600, 66.67), (2, "Bob", 300, 33.33)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_listing_detail_index_feed(spark):
    row = "<tr><td>1</td><td><a href=candidate.php?candidate_id=77>Ann B</a></td><td>IND</td><td><b> 3 </b></td><td></td><td>41</td><td>Rs 1,20,000 ~ 1 Lacs+</td><td>Nil</td></tr>"
    r = pages.listing(page(spark, f"<table>{row}</table>")).first()
    assert (r.id, r.name, r.party, r.education, r.age, r.cases, r.assets, r.liabilities) == ("77", "Ann B", "IND", "Not declared", 41, 3, 120000, 0)
    d = pages.detail(page(spark, "Gender: <i> Female</i> Profession:<b> Teacher <br> Party:</b> Red Party<br>")).first()
    assert (d.gender, d.occupation, d.party) == ("Female", "Teacher", "Red Party")
    i = pages.index(page(spark, "<h4>East</h4><a href=c1>One</a><a href=c2>Two</a><h4>West</h4><a href=c3>Three</a>"), "<h4>(.*?)</h4>", "<a href=(c\\d+)>(.*?)</a>")
    assert [(x.district, x.id, x.name) for x in i.orderBy("pos").collect()] == [("East", "c1", "One"), ("East", "c2", "Two"), ("West", "c3", "Three")]
    xml = "<item><title><![CDATA[A b]]></title><link>https://x/1</link><source url='s'>S</source></item><item><title>no link</title></item>"
    assert [(x.title, x.link, x.source) for x in pages.feed(page(spark, xml)).collect()] == [("A b", "https://x/1", "S")]


def test_report(spark):
    text = "\n".join(
        [
            "Constituency   1 . North Hill (SC)   TOTAL ELECTORS : 2000",
            "   CANDIDATE NAME   SEX",
            "   1 ANN LEE      FEMALE 41 SC AITC     500 10 510",
            "   51.00",
            "   2 BOB",
            "                 MALE 50 GENERAL IND    480 10 490  49.00",
            "      SMITH",
            "   3 NOTA          NOTA   NOTA    5 0 5 0.5",
            "   TURN OUT   TOTAL: 985 20 1005 50.25",
        ]
    )
    got = reports.results(spark.createDataFrame([("r", text)], "report string, text string")).orderBy("position").collect()
    assert [(r.ac_number, r.constituency, r.candidate, r.sex, r.age, r.party, r.votes, r.vote_share_pct, r.turnout, r.electors) for r in got] == [
        (1, "North Hill", "ANN LEE", "FEMALE", 41, "AITC", 510, 51.0, 50.25, 2000),
        (1, "North Hill", "BOB SMITH", "MALE", 50, "IND", 490, 49.0, 50.25, 2000),
        (1, "North Hill", "NOTA", "", None, "NOTA", 5, 0.5, 50.25, 2000),
    ]


def test_report_headers_and_parties(spark):
    row = "  {0} NAME{0}   M 40 GEN {1}     5 1 6 {0}.5"
    lines = ["3 . EARLY TOTAL ELECTORS : 9", row.format(1, "RLSP"), "3 . AGAIN TOTAL ELECTORS : 8", row.format(2, "BMF"), "295 . FAR TOTAL ELECTORS : 7", row.format(3, "PDS"), "Constituency 4 . OTHER TOTAL ELECTORS : 6 Page 2 of 9", row.format(4, "NEWP")]
    files_ = spark.createDataFrame([("r", "\n".join(lines)), ("none", None), ("empty", "")], "report string, text string")
    got = reports.results(files_).orderBy("position").collect()
    assert [(r.ac_number, r.constituency, r.position, r.party) for r in got] == [(3, "EARLY", 1, "RLSP"), (3, "EARLY", 2, "BMF"), (3, "EARLY", 3, "PDS"), (4, "OTHER", 4, "")]
    assert reports.results(files_, parties=("NEWP",)).where("position = 4").first().party == "NEWP"
    assert len(reports.PARTIES) == 42


def test_usual_report_lines_give_the_rows_of_all_shapes():
    lines = [
        "   1. SEAT A (SC) TOTAL ELECTORS : 1000", "   1  ANN LEE          M 31 GEN BJP   450 1 451  1.25", "   2  CARA ROY          F 33 SC CPI(M)   45 3 48", "      3.25", "      DEVI",
        "   3  BOB NOTA M 40 GEN INC   7 1 8  0.5", "   4  NOTA     NOTA NOTA   4 7 11  7.25", "   5  EVE   X          Z M 50 GEN ZZZ   1 2 3  4", "   6  DAN M 60 SC IND 5 6 11", "   7  FAY F 61 SC IND 5 6 11 2.5", "TURN OUT  TOTAL: 10 2 12 20.25",
        "   8  lone M 62 GEN IND 1 2 3 4", "   9", "      M 63 GEN IND 5 5 10 6.5",
    ]
    words, usual = reports.party_words(reports.PARTIES), reports.usual_parties(reports.PARTIES)
    for first in range(len(lines)):
        for text in ("\n".join(lines[:1] + lines[first:]), "\n\n\n\n".join(lines[:1] + lines[first:])):
            assert reports.contests(text, words, usual) == reports.contests(text, words)
    assert [r[:3] for r in reports.contests("\n".join(lines), words, usual)[0]["rows"][:2]] == [[1, "ANN LEE", "M"], [2, "CARA ROY DEVI", "F"]]
    assert not reports.usual_parties(("A B", "INC")) and not reports.usual_parties(("12",))


def test_report_rows_are_made_by_one_shuffle(spark):
    from tallyforge import bindings

    plan = bindings.QUERIES["report_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"AC Name", No.\nNorth , 1\nSouth\n')
    assert [tuple(r) for r in files.plain_csv(spark, str(tmp_path / "a.csv"), ["name", "no"]).collect()] == [("North", "1"), ("South", "")]
    (tmp_path / "b.csv").write_text('n,v\n"a, ""b""",2\n')
    assert [tuple(r) for r in files.quoted_csv(spark, str(tmp_path / "b.csv"), ["n", "v"]).collect()] == [('a, "b"', "2")]
    (tmp_path / "c.ts").write_text('import x\nexport const rows: T[] = [\n {"id": "a]", "n": 1},\n {"id": "b", "n": 2}\n]\nexport const z = 1')
    assert [tuple(r) for r in files.array_literal(spark, str(tmp_path / "c.ts"), "rows", "id string, n int").collect()] == [("a]", 1), ("b", 2)]
    files.write_csv(spark.createDataFrame([(2, "x,y"), (1, "z")], "id int, t string"), str(tmp_path / "out"), ["id"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("1", "z"), ("2", "x,y")]
    e = files.envelope(spark.createDataFrame([(1,), (2,)], "id int")).collect()
    assert {(r.data, r.total) for r in e} == {('{"id":1}', 2), ('{"id":2}', 2)}
    wide = files.wide_results(spark.createDataFrame([("2021", "3", "x", "5%"), ("2021", "", "y", "1")], "year string, ac_number string, candidate string, turnout_pct string"))
    assert [tuple(r) for r in wide.collect()] == [(2021, 3, "x", 5.0)]


def test_seeded_round_repeats(spark):
    make = lambda: synthetic.seeded_round(spark, ["a", "b"], {"a": {"P": 60.0, "Q": 40.0}, "b": {"P": 10.0, "Q": 90.0}}, {"Q": 2.0}).collect()
    assert make() == make()
    assert spark.createDataFrame(make()).groupBy("contest").agg(F.sum("votes").alias("v")).where("v between 180000 and 240001").count() == 2
    # The draws are 206659, 190736, 223713, 179590 of 233280: declared, then a point up or down for each, then the votes cast.
    assert [tuple(r) for r in make()[:2]] == [("a", "P", 132148, True), ("a", "Q", 94043, True)]
