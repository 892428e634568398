"""Sources and sinks bound to the harness tables: pages, reports and files made of a table's rows, read back as rows.

Every page, report or file holds a bounded stretch of keys, so none grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.bindings import V_CAND, bound, cand, table
from tallyforge.functions import scalar
from tallyforge.operators import matching
from tallyforge.sources import files, pages, reports

said = F.format_string


def pages_of(rows: DataFrame, url: Column, order: list[str], piece: Column, before: str = "", after: str = "") -> DataFrame:
    """Pages (url, html): the pieces of each url's rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, piece.alias("_piece"))))
    body = F.array_join(F.transform(parts, lambda x: x["_piece"]), "")
    return rows.groupBy(url.alias("url")).agg(body.alias("_b")).select("url", F.concat(F.lit(before), "_b", F.lit(after)).alias("html"))


def customers(spark, d, size: int = 100) -> DataFrame:
    """Customers (k, name, seg, url) on pages of `size` keys."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), said("p%d", F.floor(F.col("c_custkey") / size)).alias("url"))


def lines(spark, d) -> DataFrame:
    """Line items (o, n, v, flag) with whole votes."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.floor("l_extendedprice").alias("v"), F.col("l_returnflag").alias("flag"))


V_CUST = "c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, 'p' || (c_custkey // {size}) AS url FROM customer)"
V_LINES = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(floor(l_extendedprice) AS BIGINT) AS v, l_returnflag AS flag FROM lineitem)"


# ---------------------------------------------------------------- pages


@bound(f"""WITH {V_CUST.format(size=100)} SELECT url, CAST(k % 400 + 1 AS BIGINT) AS ac_number, name AS ac_name, 'L ' || k AS lead, seg AS lead_party, 'T ' || k AS trail, 'IND' AS trail_party, k * 37 % 50000 AS margin,
CAST(k % 14 AS BIGINT) AS round, CAST(14 AS BIGINT) AS rounds, k % 3 = 0 AS declared FROM c""")
def statewise_rows(spark, d):
    c = customers(spark, d)
    nested, tip = '<td><table class="in"><tbody><tr><td>%s</td><td>i</td></tr></tbody></table></td>', "<td>IND<div class='tooltip'>more</div></td>"
    row = f"<tr><td>%s</td><td>%d</td><td>L %d</td>{nested}<td>T&nbsp;%d</td>{tip}<td>%s</td><td>%d/14</td><td>%s</td></tr>"
    piece = said(row, "name", F.col("k") % 400 + 1, "k", "seg", "k", F.format_number(F.col("k") * 37 % 50000, 0), F.col("k") % 14, F.when(F.col("k") % 3 == 0, "Result Declared").otherwise("Result in Progress"))
    got = pages.statewise(pages_of(c, F.col("url"), ["k"], piece, "<table><tr><th>Contest</th></tr>", "<tr><td>short</td></tr></table>"))
    return got.select("url", F.col("ac_number").cast("long").alias("ac_number"), "ac_name", "lead", "lead_party", "trail", "trail_party", "margin", F.col("round").cast("long").alias("round"), F.col("rounds").cast("long").alias("rounds"), "declared")


@bound(f"""WITH {V_LINES} SELECT 'o' || o AS url, 'Name ' || n AS name, flag || ' & party' AS party, CASE WHEN flag = 'R' THEN 'won' ELSE 'lost' END AS status, v AS votes, bool_or(flag = 'R') OVER (PARTITION BY o) AS declared FROM l""")
def card_rows(spark, d):
    state = F.when(F.col("flag") == "R", "won").otherwise("lost")
    card = "<div class='cand-box'><div class=\"status %s\"><div>%s</div><div>%s <span>(+5)</span></div></div><h5>Name&nbsp;%d</h5><h6>%s & party</h6></div>"
    piece = said(card, state, F.upper(state), F.format_number("v", 0), "n", "flag")
    last = "<div class='cand-box'><div class=\"status lost\"><div>LOST</div><div>7</div></div><h5>NOTA</h5><h6>none</h6></div>"
    return pages.cards(pages_of(lines(spark, d), said("o%d", "o"), ["n", "v"], piece, "<body>", last)).drop("ord")


@bound(f"""WITH {V_CUST.format(size=100)} SELECT url, CAST(k % 300 AS BIGINT) AS ac_number, name AS lead, k * 11 AS votes FROM c WHERE k % 5 <> 0""")
def partywise_rows(spark, d):
    c = customers(spark, d)
    piece = said("<tr><td>%s</td><td>Seat (north) (%d)</td><td>%s</td><td>%s</td><td>1</td><td>x</td></tr>", F.when(F.col("k") % 5 == 0, F.lit("Total")).otherwise(F.col("k").cast("string")), F.col("k") % 300, "name", F.format_number(F.col("k") * 11, 0))
    got = pages.partywise(pages_of(c, F.col("url"), ["k"], piece, "<table>", "</table>"))
    return got.select("url", F.col("ac_number").cast("long").alias("ac_number"), "lead", "votes")


@bound("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages""")
def linked_ids(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("url"), "html")
    return pages.linked_ids(p, 'href="([^"]*)"').select(F.col("url").alias("page_id"), F.col("id").alias("link"))


@bound(f"""WITH {V_LINES}, r AS (SELECT *, count(*) OVER (PARTITION BY o) AS rows, sum(v) OVER (PARTITION BY o) AS total FROM l WHERE v >= 50)
SELECT 'o' || o AS url, o % 2 = 0 AS declared, 'Name ' || n AS name, flag AS party, v AS votes, floor(CASE WHEN n % 2 = 1 THEN n + 0.5::DOUBLE ELSE CAST(v AS DOUBLE) / CAST(total AS DOUBLE) * 100 END * 10000 + 0.5) / 10000 AS share FROM r WHERE rows >= 2""")
def best_table_rows(spark, d):
    l = lines(spark, d)
    piece = said("<tr><td>Name %d</td><td>%s</td><td>%s</td><td>%s</td></tr>", "n", "flag", F.format_number("v", 0), F.when(F.col("n") % 2 == 1, F.concat(F.col("n").cast("string"), F.lit(".5%"))).otherwise("-"))
    made = pages_of(l, said("o%d", "o"), ["n", "v"], piece, "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>Home</td><td>News</td><td>60</td></tr></table><table>", "</table>")
    odd = F.col("url").substr(F.lit(2), F.length("url")).cast("long") % 2
    got = pages.best_table(made.withColumn("html", F.concat("html", F.when(odd == 0, "<b>DECLARED</b>").otherwise(""))))
    return got.select("url", "declared", "name", "party", "votes", scalar.half_up("share", 4).alias("share"))


@bound(f"""WITH {V_CAND} SELECT 'p' || (id // 100) AS url, CAST(id AS VARCHAR) AS id, name, party, education, age, cases, assets, liabilities FROM cand""")
def listing_rows(spark, d):
    c = cand(spark, d)
    row = "<tr><td>%d</td><td><a href=candidate.php?candidate_id=%d>%s</a></td><td>%s</td><td align=center><b> %d </b></td><td>%s</td><td>%s</td><td>Rs&nbsp;%s<br>~ 1 Lacs+</td><td>Rs %s</td></tr>"
    shown = F.when(F.col("education") == "Not declared", "").otherwise(F.col("education"))
    piece = said(row, "id", "id", "name", "party", "cases", shown, F.when(F.col("age") > 0, F.col("age").cast("string")).otherwise(""), F.format_number("assets", 0), F.format_number("liabilities", 0))
    got = pages.listing(pages_of(c, said("p%d", F.floor(F.col("id") / 100)), ["id"], F.regexp_replace(piece, "Rs&nbsp;", "Rs "), "<table><tr><th>Sno</th></tr>", "</table>"))
    return got.select("url", "id", "name", "party", "education", F.col("age").cast("long").alias("age"), F.col("cases").cast("long").alias("cases"), "assets", "liabilities")


@bound(f"""WITH {V_CAND} SELECT 'x' || id AS url, CASE WHEN id % 5 <> 0 THEN 'https://pics.example/images_candidate/' || id || '.jpg' END AS photo, coalesce(gender, 'Male') AS gender, CASE WHEN id % 4 <> 0 THEN 'Farmer ' || id END AS occupation, party FROM cand""")
def detail_rows(spark, d):
    c = cand(spark, d)
    photo = F.when(F.col("id") % 5 != 0, said('<img src="https://pics.example/images_candidate/%d.jpg">', "id")).otherwise("")
    sex = F.when(F.col("gender").isNotNull(), said("Gender: <b>%s</b>", "gender")).otherwise("")
    work = said("<p>Profession : <b>%s</b></p>", F.when(F.col("id") % 4 == 0, "NIL").otherwise(said("Farmer %d", "id")))
    side = F.when(F.col("id") % 2 == 0, said("<b>Party:</b>&nbsp;%s<br>", "party")).otherwise(said("Party is <b>%s</b>", "party"))
    return pages.detail(c.select(said("x%d", "id").alias("url"), F.concat(photo, sex, work, side).alias("html")))


@bound(f"""WITH {V_CAND} SELECT 'x' || id AS url, 'Ann Lee ' || id AS name, CASE WHEN id % 3 = 0 THEN party WHEN id % 3 = 1 THEN 'XYZ)' ELSE 'IND' END AS party, 'c' || lpad(CAST(ac AS VARCHAR), 4, '0') AS contest, age,
CASE WHEN id % 5 = 0 THEN 'Male' WHEN id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE WHEN id % 4 <> 0 THEN 'Farmer & Co' ELSE '' END AS occupation, cases FROM cand WHERE id % 11 <> 0""")
def titled_detail_rows(spark, d):
    c = cand(spark, d)
    i = F.col("id")
    title = F.when(i % 3 == 1, said("ANN LEE %d(Some Party(XYZ)):Seat", i)).otherwise(said("ann lee %d(a party):Seat", i))
    labels = F.concat(
        F.when(i % 3 == 0, said("<div><b>Party:</b> %s </div>", "party")).otherwise(""),
        said("<a href='index.php?constituency_id=%d'>SEAT</a> &rarr; <b>name</b><b>Age:</b> %d", "ac", "age"),
        F.when(i % 2 == 0, "<b>S/o|D/o|W/o:</b> Somebody<br>").otherwise(""),
        F.when(i % 5 == 0, "<b title=Gender> Male</b>").otherwise(""),
        F.when(i % 4 != 0, "<b>Self Profession:</b> Farmer  &&nbsp;Co<br>").otherwise(""),
        said("Number of Criminal Cases: <span class=x>%d</span>", "cases"),
    )
    # Every eleventh page is an error page: short, or without a title.
    html = F.when(i % 22 == 11, "<title>gone(x)</title>").when(i % 11 == 0, F.repeat(F.lit("error "), 100)).otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>"), labels, F.repeat(F.lit(" "), 500)))
    got = pages.titled_detail(c.select(said("x%d", i).alias("url"), html.alias("html"))).drop("photo", "spouse_occupation")
    return got.withColumns({n: F.col(n).cast("long") for n in ("age", "cases")})


@bound(f"""WITH {V_CAND} SELECT 'x' || id AS url, CASE WHEN id % 7 <> 0 THEN assets ELSE 0 END AS total, liabilities FROM cand""")
def finance_rows(spark, d):
    c = cand(spark, d)
    sums = lambda v: said('<td style="color:purple"><b>Rs 1</b></td><td style="color: purple;"><b>Rs %s</b></td>', F.format_number(v, 0))
    html = F.concat(F.lit("<h3>Movable</h3>"), F.when(F.col("id") % 7 != 0, sums("assets")).otherwise(""), F.lit("<h3>Debts</h3>"), sums("liabilities"))
    p = c.select(said("x%d", "id").alias("url"), html.alias("html"))
    return pages.finances(p, "Movable", "Debts").join(pages.finances(p, "Debts", "Nothing").withColumnRenamed("total", "liabilities"), "url")


@bound(f"""WITH {V_CUST.format(size=70)} SELECT url, 'D ' || max(CASE WHEN k % 7 = 0 THEN k END) OVER (PARTITION BY url ORDER BY k) AS district, CAST(k AS VARCHAR) AS id, name FROM c""")
def index_rows(spark, d):
    c = customers(spark, d, 70)
    piece = F.concat(F.when(F.col("k") % 7 == 0, said("<h5> D %d </h5>", "k")).otherwise(""), said("<a href='show.php?constituency_id=%d'> %s</a>", "k", "name"))
    return pages.index(pages_of(c, F.col("url"), ["k"], piece), r"<h5>([^<]+)</h5>", r"<a href='show\.php\?constituency_id=(\d+)'>([^<]+)</a>").drop("pos")


@bound(f"""WITH {V_CUST.format(size=100)} SELECT url, name, seg AS party FROM c WHERE k % 11 <> 0""")
def first_table_rows(spark, d):
    c = customers(spark, d)
    piece = said("<tr class=r><td>%d</td><td>%s</td><td>%s</td></tr>", "k", F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("name")), "seg")
    made = pages_of(c, F.col("url"), ["k"], piece, '<table class="nav"><tr><td>0</td><td>no</td></tr></table><table class="tbl w3-table"><tr><td>No</td><td>Name</td></tr>', '</table><table class="w3-table"><tr><td>x</td></tr><tr><td>1</td><td>later</td></tr></table>')
    return pages.first_table(made, "w3-table").select("url", F.get("cells", F.lit(1)).alias("name"), F.get("cells", F.lit(2)).alias("party"))


@bound(f"""WITH {V_CUST.format(size=100)} SELECT url, name || ' wins' AS title, 'https://news.example/' || k AS link, seg AS source, 'day ' || k AS published FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k) AS place FROM c) WHERE place <= 6 AND k % 4 <> 0""")
def feed_rows(spark, d):
    c = customers(spark, d)
    title = F.when(F.col("k") % 2 == 0, said("<title><![CDATA[%s wins]]></title>", "name")).otherwise(said("<title>%s wins</title>", "name"))
    link = F.when(F.col("k") % 4 != 0, said("<link>https://news.example/%d</link>", "k")).otherwise("<link></link>")
    piece = F.concat(F.lit("<item>"), title, link, said("<source url='x'>%s</source><pubDate>day %d</pubDate></item>", "seg", "k"))
    return pages.feed(pages_of(c, F.col("url"), ["k"], piece, "<rss><channel><title>All</title>", "</channel></rss>"), 6).drop("pos")


@bound("""SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS found FROM orders""")
def url_values(spark, d):
    url = said("https://x.example/show?action=a&candidate_id=%d&page=2", "o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pages.url_value(url, "candidate_id").alias("found"))


# ---------------------------------------------------------------- reports

_FIRST = ("ASHA", "BIMAL", "CHITRA", "DIPAK", "ESHA", "FARID", "GITA", "HARI")
_SIDES = ("AITC", "BJP", "CPI(M)", "INC")
#: Lines of reports that a task makes and reads.
REPORT_LINES = 500_000


@bound(f"""WITH {V_LINES} SELECT 'r' || (o // 20) AS report, CAST(o % 20 + 1 AS BIGINT) AS ac_number, 'SEAT ' || chr(CAST(65 + o % 20 AS INT)) AS constituency, o + 1000 AS electors, o % 60 + 20.25::DOUBLE AS turnout, CAST(n AS BIGINT) AS position,
CASE WHEN n = 7 THEN 'NOTA' ELSE {list(_FIRST)!r}[n] || ' ROY' || CASE WHEN n = 4 THEN ' DEVI' ELSE '' END END AS candidate, CASE WHEN n = 7 THEN 'NOTA' ELSE {list(_SIDES)!r}[n % 4 + 1] END AS party,
CASE WHEN n <> 7 THEN CASE WHEN n % 2 = 0 THEN 'F' ELSE 'M' END ELSE '' END AS sex, CAST(CASE WHEN n <> 7 THEN 30 + n ELSE 0 END AS BIGINT) AS age, CASE WHEN n = 7 THEN 'NOTA' WHEN n % 2 = 0 THEN 'SC' ELSE 'GEN' END AS category,
v AS votes_general, CAST(n AS BIGINT) AS votes_postal, v + n AS votes, n + 0.25::DOUBLE AS vote_share_pct FROM l""")
def report_rows(spark, d):
    # One shuffle, of numbers: a report's lines meet in a row, and its text is written there. A task's share of lines is bounded.
    every = lines(spark, d).select(F.floor(F.col("o") / 20).alias("r"), "o", "n", "v")
    tasks = max(spark.sparkContext.defaultParallelism, every.count() // REPORT_LINES + 1)
    made = every.repartition(tasks, "r").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("o", "n", "v"))).alias("_all"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    def piece(x: Column, i: Column) -> Column:
        o, n, v, end = x["o"], x["n"], x["v"], F.size("_all")
        # The share of every third contestant stands on the next line; the fourth one's name goes on there.
        person = F.concat(pick([f"{f} ROY          " for f in _FIRST], n), F.when(n % 2 == 0, "F ").otherwise("M "), n + 30, F.when(n % 2 == 0, " SC ").otherwise(" GEN "), pick(_SIDES, n % 4 + 1))
        row = F.concat(F.lit("   "), n, F.lit("  "), F.when(n == 7, "NOTA     NOTA NOTA").otherwise(person), F.lit("   "), v, F.lit(" "), n, F.lit(" "), v + n, F.when(n % 3 == 0, "\n      ").otherwise("  "), n, F.when(n == 4, ".25\n      DEVI\n").otherwise(".25\n"))
        head = F.concat(F.lit("DETAILED RESULTS\n  "), o % 20 + 1, F.lit(". SEAT "), F.char(o % 20 + 65), F.lit(" (SC) TOTAL ELECTORS : "), o + 1000, F.lit("\n\n"))
        foot = F.concat(F.lit("TURN OUT  TOTAL: 10 2 12 "), o % 60 + 20, F.lit(".25\n  Page 3 of 9\n"))
        first, last = (i == 0) | (F.get("_all", i - 1)["o"] != o), (i == end - 1) | (F.get("_all", i + 1)["o"] != o)
        return F.concat(F.when(first, head).otherwise(""), F.coalesce(row, F.lit("")), F.when(last, foot).otherwise(""))

    got = reports.results(made.select(F.concat(F.lit("r"), "r").alias("report"), F.array_join(F.transform("_all", piece), "").alias("text")))
    return got.withColumns({"ac_number": F.col("ac_number").cast("long"), "age": F.coalesce(F.col("age").cast("long"), F.lit(0)), "position": F.col("position").cast("long")})


# ---------------------------------------------------------------- files


@bound("""SELECT p_partkey AS id, p_name || ', "' || p_brand || '"' AS name, CAST(p_size AS VARCHAR) AS size FROM part""")
def csv_round_trip(spark, d):
    out = table(spark, d, "part").select(F.col("p_partkey").alias("id"), said('%s, "%s"', "p_name", "p_brand").alias("name"), "p_size")
    path = files.scratch(spark, "csv")
    files.write_csv(out, path, ["id"])
    return files.quoted_csv(spark, path, ["id", "name", "size"]).withColumn("id", F.col("id").cast("long"))


@bound("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part""")
def plain_csv_rows(spark, d):
    out = table(spark, d, "part").select("p_partkey", said(" %s ", "p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"))
    path = files.scratch(spark, "plain")
    out.write.option("header", True).option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.plain_csv(spark, path, ["id", "name", "brand"])


@bound("""SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part""")
def json_cache(spark, d):
    path = files.scratch(spark, "cache")
    files.write_json(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), path)
    return files.json_rows(spark, path, "id long, name string, size int", arrays=False)


def _arrays(spark, d, label: str, before: str, after: str) -> str:
    """Files of JSON arrays, each of a stretch of keys; texts hold brackets and quotes."""
    item = F.to_json(F.struct(F.col("p_partkey").alias("id"), said('%s ]; "[%s', "p_name", "p_brand").alias("name"), F.array("p_size").alias("sizes")))
    p = table(spark, d, "part").withColumn("stretch", F.floor(F.col("p_partkey") / 10_000))
    body = p.groupBy("stretch").agg(F.array_join(F.array_sort(F.collect_list(item)), ",\n").alias("b"))
    path = files.scratch(spark, label)
    body.select("stretch", F.concat(F.lit(before), "b", F.lit(after)).alias("value")).write.partitionBy("stretch").text(path)
    return path


_ITEMS = """SELECT p_partkey AS id, p_name || ' ]; "[' || p_brand AS name, CAST(p_size AS BIGINT) AS size FROM part"""


@bound(_ITEMS)
def json_arrays(spark, d):
    path = _arrays(spark, d, "arrays", "[\n", "\n]")
    return files.json_rows(spark, path, "id long, name string, sizes array<long>").select("id", "name", F.get("sizes", F.lit(0)).alias("size"))


@bound(_ITEMS)
def array_literals(spark, d):
    path = _arrays(spark, d, "literals", "import x from 'y';\nexport const other: T[] = [1];\nexport const parts: Part[] = [", "];\nexport const late = [2];\n")
    return files.array_literal(spark, path, "parts", "id long, name string, sizes array<long>").select("id", "name", F.get("sizes", F.lit(0)).alias("size"))


@bound("""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_custkey AS ac_number, 'C ' || o_orderkey AS candidate, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS votes, o_orderkey % 100 + 0.5::DOUBLE AS vote_share_pct FROM orders WHERE o_orderkey % 9 <> 0 AND o_custkey > 0""")
def wide_result_rows(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    given = {
        "year": F.year("o_orderdate").cast("string"),
        "ac_number": F.when(k % 9 == 0, "").otherwise(F.col("o_custkey").cast("string")),
        "candidate": said("C %d ", k),
        "votes": F.when(k % 5 == 0, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0)),
        "vote_share_pct": said("%d.5%%", k % 100),
    }
    path = files.scratch(spark, "wide")
    o.select(*[given.get(c, F.lit("0")).alias(c) for c in files.RESULT_COLUMNS]).write.option("header", True).option("escape", '"').csv(path)
    got = files.wide_results(files.quoted_csv(spark, path, files.RESULT_COLUMNS))
    return got.select("year", "ac_number", "candidate", "votes", "vote_share_pct")


@bound("""SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) || ',' || CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || ', ""x""' || '"' ELSE p_name END AS line FROM part""")
def csv_lines(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, said('%s, "x"', "p_name")).otherwise(F.col("p_name")).alias("name"))
    return files.csv_lines(p).select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("id"), "line")


@bound("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer""")
def table_round_trip(spark, d):
    path = files.scratch(spark, "table")
    files.write_table(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), path)
    return spark.read.parquet(path)


V_YEARS = "o AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders)"


@bound(f"""WITH {V_YEARS}, last AS (SELECT max(yr) AS y, min(yr) AS f FROM o)
SELECT id, yr AS year, CASE WHEN yr % 2 = 0 THEN 'wide' WHEN yr < y THEN 'plain' ELSE 'winners' END AS source FROM o, last WHERE CASE WHEN yr % 2 = 0 THEN id % 2 = 0 WHEN yr < y THEN id % 3 = 0 ELSE id % 5 = 0 END""")
def source_priority(spark, d):
    """Even years stand in the wide file, all but the last odd one in the plain file, every year in the winners' file."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"))
    last = o.agg(F.max("year")).first()[0] or 0
    from_ = lambda rows, name: rows.withColumn("source", F.lit(name))
    wide, plain = o.where("year % 2 = 0 and id % 2 = 0"), o.where("id % 3 = 0").where((F.col("year") < last) | (F.col("year") % 2 == 0))
    return files.chosen_history(from_(wide, "wide"), from_(plain, "plain"), from_(o.where("id % 5 = 0"), "winners"), last).select("id", "year", "source")


@bound(f"""WITH {V_CAND} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS chunk FROM cand""")
def post_batches(spark, d):
    return matching.chunks(cand(spark, d).select("id"), "id").select("id", "chunk")


@bound(f"""WITH {V_CAND} SELECT CAST(id AS VARCHAR) AS id, name, CAST(assets AS VARCHAR) AS assets, count(*) OVER () AS total FROM cand WHERE cases > 3""")
def listing_envelope(spark, d):
    e = files.envelope(cand(spark, d).where("cases > 3").select("id", "name", "assets"))
    return e.select(*[F.get_json_object("data", f"$.{c}").alias(c) for c in ("id", "name", "assets")], "total")
