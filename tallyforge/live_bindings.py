"""Live documents, entries by hand, small listings, read queries and streams bound to the harness tables, each with its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tallyforge.bindings import NOW, V_CAND, V_JOB, V_VOTES, WON, bound, cand, events, job, table, won
from tallyforge.column_bindings import event, part
from tallyforge.functions import scalar
from tallyforge.operators import contest, keys, listing, live, matching, people, quiz
from tallyforge.plans import api
from tallyforge.plans import live as plan
from tallyforge.source_bindings import V_CUST, V_LINES, customers, lines, pages_of, said
from tallyforge.sources import files, keyed
from tallyforge.streaming.live import Summary, first_seen, first_seen_state, landed, latest_state, pages_until_failure, run_available, upsert_latest
from tallyforge.streaming.state import State

# ---------------------------------------------------------------- documents

_NAMES = ["Ann", "Bea", "Cy", "Dan", "Eve"]


def _person(i):
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (i % 5 + 1).cast("int"))


@bound(f"""WITH {V_LINES}, s AS (SELECT 'a' || o_orderkey AS id, o_orderkey AS o, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE {_NAMES!r}[o_orderkey % 5 + 1] END AS lead, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 17 = 0 THEN '' ELSE 'Zed' END AS trail,
CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_custkey END AS margin, o_orderstatus = 'F' AS declared FROM orders WHERE o_orderkey % 13 <> 0),
d AS (SELECT o, n, CAST(sum(v) AS BIGINT) AS v, min(flag) AS flag FROM l WHERE o % 2 = 0 GROUP BY ALL), f AS (SELECT o, arg_min({_NAMES!r}[n % 5 + 1], (-v, n)) AS leader, arg_min(flag, (-v, n)) AS party, CAST(sum(v) AS BIGINT) AS total, max(v, 2) AS top, bool_or(n = 1 AND flag = 'R') AS won FROM d GROUP BY o),
p AS (SELECT o, {_NAMES!r}[count(*) % 5 + 1] || '.' AS lead, CAST(sum(v) AS BIGINT) AS votes FROM l WHERE o % 3 = 0 GROUP BY o),
j AS (SELECT s.*, f.leader, f.party, f.total, f.top, f.won, f.o IS NOT NULL AS "full", CASE WHEN p.lead = s.lead || '.' THEN p.votes ELSE 0 END AS lv FROM s LEFT JOIN f USING (o) LEFT JOIN p ON p.o = s.o WHERE NOT (s.lead = '' AND s.trail = '' AND s.margin = 0))
SELECT id, CASE WHEN "full" THEN leader ELSE lead END AS leader, CASE WHEN "full" THEN party ELSE 'A' END AS leader_party,
 CASE WHEN "full" AND len(top) > 1 AND top[1] > top[2] THEN top[1] - top[2] ELSE margin END AS margin,
 CASE WHEN "full" THEN total ELSE lv + CASE WHEN trail <> '' AND lv > 0 AND margin > 0 THEN greatest(0, lv - margin) ELSE 0 END END AS total, coalesce(won, false) OR declared AS declared FROM j""")
def live_documents(spark, d):
    """A contest in two has a detail page, one in three party-wise votes; one in seventeen says nothing."""
    k, empty = F.col("o_orderkey"), F.col("o_orderkey") % 17 == 0
    state = table(spark, d, "orders").select(
        F.when(k % 13 != 0, said("a%d", k)).alias("id"),
        k.alias("ac_number"),
        F.when(empty, "").otherwise(_person(k)).alias("lead"),
        F.lit("A").alias("lead_party"),
        F.when(empty | (k % 4 == 0), "").otherwise("Zed").alias("trail"),
        F.lit(None).cast("string").alias("trail_party"),
        F.when(empty, 0).otherwise(F.col("o_custkey")).alias("margin"),
        (F.col("o_orderstatus") == "F").alias("declared"),
    )
    l = lines(spark, d)
    detail = l.where("o % 2 = 0").groupBy(F.col("o").alias("ac_number"), F.col("n").alias("ord")).agg(F.sum("v").alias("votes"), F.min("flag").alias("party"))
    detail = detail.withColumn("name", _person(F.col("ord"))).withColumn("status", F.when((F.col("ord") == 1) & (F.col("party") == "R"), "won").otherwise("lost"))
    by_party = l.where("o % 3 = 0").groupBy(F.col("o").alias("ac_number")).agg(F.concat(_person(F.count("*")), F.lit(".")).alias("lead"), F.sum("v").alias("votes"))
    return live.documents(state, detail, by_party).select("id", "leader", "leader_party", "margin", "total", "declared")


def _docs(spark, d):
    return won(spark, d, NOW).select(F.col("ac").alias("id"), F.concat(F.lit("L "), "party").alias("leader"), F.col("party").alias("leader_party"), "margin", (F.col("ac") % 2 == 0).alias("declared"))


def _before(spark, d):
    return won(spark, d, NOW).where("ac % 4 = 0").select(F.col("ac").alias("id"), F.lit("t0").alias("declared_at"))


V_DOCS = f"""{V_VOTES}, {WON}, docs AS (SELECT ac AS id, 'L ' || party AS leader, party AS leader_party, margin, ac % 2 = 0 AS declared, CASE WHEN ac % 4 = 0 THEN 't0' WHEN ac % 2 = 0 THEN 't1' END AS declared_at FROM won WHERE yr = {NOW}),
tight AS (SELECT string_agg(id || ':' || margin, ',' ORDER BY margin, id) AS tightest FROM (SELECT * FROM docs WHERE margin > 0 ORDER BY margin, id LIMIT 10))"""


def _joined(items, f):
    return F.array_join(F.transform(items, f), ",")


@bound(f"""WITH {V_DOCS} SELECT count(*) AS contests, count(*) FILTER (declared) AS declared, string_agg(id || ':' || leader_party, ',' ORDER BY id) AS leaders, string_agg(id || ':' || margin, ',' ORDER BY id) FILTER (margin > 0) AS margins,
string_agg(declared_at || ':' || id, ',' ORDER BY declared_at DESC, id DESC) FILTER (declared) AS winners, (SELECT tightest FROM tight) AS tightest FROM docs""")
def live_summary(spark, d):
    s = live.summary(_docs(spark, d), _before(spark, d), F.lit("t1"))
    pair = lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))
    return s.select(
        "contests",
        "declared",
        _joined(F.map_entries("leader_by_contest"), pair).alias("leaders"),
        _joined(F.map_entries("margin_by_contest"), pair).alias("margins"),
        _joined("winners", lambda w: F.concat_ws(":", w["declared_at"], w["id"].cast("string"))).alias("winners"),
        _joined("tightest", lambda t: F.concat_ws(":", t["id"].cast("string"), t["margin"].cast("string"))).alias("tightest"),
    )


@bound(f"""WITH {V_DOCS} SELECT count(*) AS contests, count(*) FILTER (declared) AS declared, (SELECT tightest FROM tight) AS tightest FROM docs""")
def live_summary_reduced(spark, d):
    s = live.summary(_docs(spark, d), _before(spark, d), F.lit("t1"), reduced=True)
    return s.select("contests", "declared", _joined("tightest", lambda t: F.concat_ws(":", t["id"].cast("string"), t["margin"].cast("string"))).alias("tightest"))


@bound(f"""WITH {V_DOCS} SELECT * FROM docs""")
def kept_declaration_times(spark, d):
    return live.summary_rows(_docs(spark, d), _before(spark, d), F.lit("t1"))


def _updates(spark, d):
    """Entries for orders by their line items: one in seven empty, third contestants without votes, fifth ones below 0."""
    l = lines(spark, d).groupBy("o", "n").agg(F.sum("v").alias("v"), F.min("flag").alias("flag"))
    votes = F.when(F.col("n") == 5, -1).when(F.col("n") != 3, F.col("v"))
    items = F.array_sort(F.collect_list(F.struct("n", said("N%d", "n").alias("name"), F.col("flag").alias("party"), votes.alias("votes"))))
    u = l.groupBy(F.col("o").alias("id")).agg(items.alias("contestants"))
    u = u.withColumn("contestants", F.when(F.col("id") % 7 == 0, F.filter("contestants", lambda c: F.lit(False))).otherwise(F.col("contestants")))
    known = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"))
    return u.withColumn("at", F.lit(1)).withColumn("declared", F.col("id") % 2 == 0), known


V_UPDATES = f"""{V_LINES}, g AS (SELECT o, n, CAST(sum(v) AS BIGINT) AS v, min(flag) AS flag FROM l GROUP BY ALL), good AS (SELECT * FROM g WHERE n NOT IN (3, 5)),
why AS (SELECT o AS id, CASE WHEN o % 10 = 0 OR o NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown contest' WHEN o % 7 = 0 THEN 'no contestants' WHEN count(*) FILTER (n NOT IN (3, 5)) = 0 THEN 'no valid contestant' END AS reason FROM g GROUP BY o)"""


@bound(f"""WITH {V_UPDATES}, x AS (SELECT o AS id, arg_min('N' || n || ':' || flag, (-v, n)) AS first, arg_min(flag, (-v, n)) AS leader_party, max(v, 2) AS top, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM good GROUP BY o)
SELECT id, id || ':' || first || ':0' AS leader_id, leader_party, top[1] - coalesce(top[2], 0) AS margin, total, n, id % 2 = 0 AS declared, floor(CAST(top[1] AS DOUBLE) / CAST(total AS DOUBLE) * 100 * 100 + 0.5) / 100 AS share FROM x JOIN why USING (id) WHERE reason IS NULL
UNION ALL SELECT -1, '-1:x:y:0', 'y', 5, 5, 1, true, 100""")
def entered_documents(spark, d):
    u, known = _updates(spark, d)
    kind = "id long, contestants array<struct<contestant_id:string,name:string,party:string,votes:long,share:double>>, leader_party string, leader string, margin long, total long, declared boolean"
    stored = spark.createDataFrame([(-1, [("-1:x:y:0", "x", "y", 5, 100.0)], "y", "x", 5, 5, True), (1, [], "old", "old", 0, 0, False)], kind)
    first = F.get("contestants", F.lit(0))
    out = plan.entered(u, known, stored, F.lit("t1"))[0]
    return out.select("id", first["contestant_id"].alias("leader_id"), "leader_party", "margin", "total", F.size("contestants").cast("long").alias("n"), "declared", scalar.half_up(first["share"], 2).alias("share"))


@bound(f"""WITH {V_UPDATES} SELECT id, reason FROM why WHERE reason IS NOT NULL""")
def rejected_entries(spark, d):
    u, known = _updates(spark, d)
    return live.checked(u, known).where("reason is not null").select("id", "reason")


@bound("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'win' ELSE 'lose' END WHEN o_custkey % 2 = 0 THEN 'lead' ELSE 'trail' END AS state, greatest(0, CAST(floor(o_totalprice) AS BIGINT) - 200000) AS behind FROM orders""")
def banner_states(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), live.banner(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0).alias("state"), live.behind(F.floor("o_totalprice"), F.lit(200000)).alias("behind"))


@bound("""SELECT o_orderkey AS id, t = 0 AND o_custkey > 0 AS pending, floor(CASE WHEN t > 0 THEN CAST(o_custkey AS DOUBLE) / CAST(t AS DOUBLE) * 100 ELSE 0 END * 1000 + 0.5) / 1000 AS margin_share, o_orderkey % 4 <> 0 AND o_orderkey % 2 = 1 AS flipped, o_orderkey % 4 <> 0 AND o_orderkey % 2 = 0 AS retained
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS t FROM orders)""")
def counting_states(spark, d):
    k = F.col("o_orderkey")
    total = F.when(k % 3 == 0, 0).otherwise(F.floor("o_totalprice"))
    state = live.counting_state(total, F.col("o_custkey"), F.when(k % 4 != 0, F.lit("A")), F.when(k % 2 == 1, F.lit("B")).otherwise("A"))
    return table(spark, d, "orders").select(k.alias("id"), state.alias("s")).select("id", "s.pending", scalar.half_up("s.margin_share", 3).alias("margin_share"), "s.flipped", "s.retained")


@bound("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 ELSE o_custkey END AS margin FROM orders""")
def live_margins(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), contest.live_margin(F.col("o_custkey") % 3, F.col("o_custkey")).alias("margin"))


@bound(f"""WITH {V_LINES}, x AS (SELECT o AS id, list('N' || n % 3 || ':' || v ORDER BY v DESC, n) AS a FROM (SELECT o, n, CAST(sum(v) AS BIGINT) AS v FROM l GROUP BY ALL) GROUP BY o)
SELECT id, array_to_string(list_concat(a[1:2], list_filter(a, lambda c: c[1:2] <> a[1][1:2] AND (len(a) < 2 OR c[1:2] <> a[2][1:2]))), ',') AS contestants FROM x""")
def reshaped_history(spark, d):
    l = lines(spark, d).groupBy("o", "n").agg(F.sum("v").alias("v"))
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("_o"), "n", "v"))), lambda x: F.struct(said("N%d", x["n"] % 3).alias("name"), x["v"].alias("votes")))
    h = l.groupBy(F.col("o").alias("id")).agg(items.alias("top"))
    h = h.withColumns({"winner": F.get("top", F.lit(0)), "runner_up": F.get("top", F.lit(1))})
    return live.reshaped(h).select("id", _joined("contestants", lambda c: F.concat_ws(":", c["name"], c["votes"].cast("string"))).alias("contestants"))


@bound(f"""WITH {V_LINES} SELECT DISTINCT o AS ac, n, 'a' || o || ':Name ' || n || ':' || CASE WHEN n % 2 = 0 THEN 'X' ELSE '' END || ':' || n AS id FROM l""")
def contestant_ids(spark, d):
    l = lines(spark, d).select("o", "n").distinct()
    made = live.contestant_id(said("a%d", "o"), said("Name %d", "n"), F.when(F.col("n") % 2 == 0, "X"), F.col("n"))
    return l.select(F.col("o").alias("ac"), "n", made.alias("id"))


@bound("""SELECT key, written, unmatched, CASE WHEN written = 0 THEN 'error' WHEN unmatched > 0 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT user_id AS key, count(*) FILTER (event_type = 'purchase') AS written, count(*) FILTER (event_id % 50 = 0) AS unmatched FROM events GROUP BY 1)""")
def run_states(spark, d):
    e = events(spark, d).groupBy("key").agg(F.count_if("declared").alias("written"), F.count_if(F.col("event_id") % 50 == 0).alias("unmatched"))
    return e.withColumn("status", live.run_status(F.col("written"), F.col("unmatched")))


@bound(f"""WITH {V_CAND} SELECT id, ' Live ' AS phase FROM cand""")
def phase_gates(spark, d):
    c = cand(spark, d).select("id")
    parts = [live.gated(c, p).select("id", F.lit(p or "none").alias("phase")) for p in (" Live ", "post", "pre", "odd", None)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@bound("""SELECT c_custkey AS ac_number, c_name AS candidate, c_mktsegment AS party, CAST(0 AS BIGINT) AS votes, 0::DOUBLE AS share, c_custkey * 3 AS margin, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 ELSE -1 END AS electors FROM customer""")
def winners_file_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ac_number"), F.col("c_name").alias("candidate"), F.col("c_mktsegment").alias("party"), (F.col("c_custkey") * 3).alias("margin"), (F.col("c_custkey") % 4).alias("electors"))
    return listing.winners_as_results(c).withColumn("electors", F.coalesce("electors", F.lit(-1)))


@bound("""SELECT p_partkey AS id, '[{"id":"a","text":"' || p_name || '"},{"id":"b","text":"' || p_brand || '"}]' AS options FROM part""")
def public_questions(spark, d):
    option = lambda i, t: F.struct(F.lit(i).alias("id"), F.col(t).alias("text"), F.create_map(F.lit("X"), F.col("p_size")).alias("weights"))
    q = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(option("a", "p_name"), option("b", "p_brand")).alias("options"))
    return quiz.public_questions(q).select("id", F.to_json("options").alias("options"))


@bound("""SELECT s_suppkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'old' ELSE 'region ' || n_regionkey END AS district, n_nationkey % 6 <> 0 AS changed FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def corrected_districts(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("nation"), said("region %d", "n_regionkey").alias("value"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("old").alias("district"))
    return matching.corrected(s, n, "nation", "district").select("id", "district", F.col("_changed").alias("changed"))


@bound("""WITH x AS (SELECT n_regionkey AS r, count(*) AS nations, sum(n_nationkey) AS total FROM nation WHERE n_regionkey <> 3 GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 10 = 0 THEN 99 ELSE coalesce(nations, -1) END AS nations, coalesce(CAST(total AS BIGINT), -1) AS total, CASE WHEN r IS NULL THEN 'no district figures' WHEN r = 2 THEN 'figures of region 1' ELSE '' END AS note FROM nation LEFT JOIN x ON r = n_regionkey""")
def fanned_out_figures(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("district"), "n_nationkey")
    districts = n.where("district <> 3").groupBy("district").agg(F.count("*").alias("nations"), F.sum("n_nationkey").alias("total"))
    districts = districts.withColumn("proxy", F.when(F.col("district") == 2, "region 1"))
    own = n.where("id % 10 = 0").select("id", F.lit(99).cast("long").alias("nations"), F.lit(None).cast("long").alias("total"))
    out = matching.fanned_out(n.select("id", "district"), districts, own, "id", "district", ["nations", "total"])
    return out.select("id", F.coalesce("nations", F.lit(-1)).alias("nations"), F.coalesce("total", F.lit(-1)).alias("total"), F.coalesce("note", F.lit("")).alias("note"))


@bound("""SELECT user_id AS key, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def recent_kept(spark, d):
    return keys.kept_few(events(spark, d).select("key", "event_id"), ["key"], "event_id", 3, "last")


@bound("""SELECT event_type AS party, user_id AS key, min(event_id) AS event_id FROM events GROUP BY ALL ORDER BY 3 LIMIT 6""")
def featured_kept(spark, d):
    return keys.kept_few(events(spark, d).select("party", "key", "event_id"), ["party", "key"], "event_id", 6)


@bound("""SELECT n_regionkey AS region, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS items FROM nation GROUP BY 1""")
def nested_groups(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_regionkey", "region")
    return listing.nested(n, ["region"], "n_nationkey", ["n_nationkey", "n_name"]).withColumn("items", F.to_json("items"))


@bound(f"""WITH {V_VOTES}, {WON}, s AS (SELECT party, count(*) AS seats, count(*) FILTER (ac % 3 = 0) AS won FROM won WHERE yr = {NOW} GROUP BY 1 ORDER BY seats DESC, party LIMIT 1) SELECT *, seats >= 6 AS projected, won >= 6 AS confirmed FROM s WHERE seats >= 6 OR won >= 6""")
def majority_state(spark, d):
    s = won(spark, d, NOW).groupBy("party").agg(F.count("*").alias("seats"), F.count_if(F.col("ac") % 3 == 0).alias("won"))
    return contest.majority_state(s, 6)


@bound(f"""WITH {V_VOTES}, {WON}, n AS (SELECT party, count(*) AS seats, sum(share) AS s FROM won WHERE yr = {NOW} GROUP BY 1), p AS (SELECT DISTINCT party FROM votes WHERE yr = {NOW} UNION SELECT party FROM won WHERE yr = {NOW - 1})
SELECT party, floor(coalesce(s / seats, 0) * 1000 + 0.5) / 1000 AS avg_share FROM p LEFT JOIN n USING (party)""")
def mean_winning_share(spark, d):
    from tallyforge.bindings import BEFORE, votes

    return contest.scorecard(won(spark, d, BEFORE), won(spark, d, NOW), votes(spark, d, NOW)).select("party", scalar.half_up("avg_share", 3).alias("avg_share"))


def _sorted_page(spark, d, how: str):
    c = cand(spark, d)
    return keys.paged(c, people.sorted_by(c, how), 3, 30).select("id", "cases", "age")


@bound(f"""WITH {V_CAND} SELECT id, cases, age FROM cand ORDER BY cases DESC, id LIMIT 30 OFFSET 60""")
def cases_page(spark, d):
    return _sorted_page(spark, d, "cases-desc")


@bound(f"""WITH {V_CAND} (SELECT 'up' AS way, id, cases, age FROM cand ORDER BY age, id LIMIT 30 OFFSET 60) UNION ALL (SELECT 'down', id, cases, age FROM cand ORDER BY age DESC, id LIMIT 30 OFFSET 60)""")
def age_pages(spark, d):
    return _sorted_page(spark, d, "age-asc").withColumn("way", F.lit("up")).unionByName(_sorted_page(spark, d, "age-desc").withColumn("way", F.lit("down")))


@bound("""SELECT year, n, row_number() OVER (ORDER BY year DESC) AS place FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1)""")
def year_order(spark, d):
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return keys.numbered(years, [F.desc("year")])


@bound(f"""WITH {V_CAND} SELECT id, name AS contest, CAST(ac AS VARCHAR) AS district FROM cand""")
def packed_fields(spark, d):
    """The parts of a field that holds several, by their place."""
    part_of = F.split("place", r"\|")
    return cand(spark, d).select("id", F.get(part_of, F.lit(0)).alias("contest"), F.get(part_of, F.lit(1)).alias("district"))


@bound(f"""WITH {V_CAND}, p(party, label, color) AS (VALUES ('BUILDING', 'Builders', '#112233'), ('MACHINERY', 'Makers', '#445566')) SELECT label, color, count(*) AS n FROM cand JOIN p USING (party) GROUP BY ALL""")
def constant_dimension(spark, d):
    parties = files.constant_table(spark, "party string, label string, color string", [("BUILDING", "Builders", "#112233"), ("MACHINERY", "Makers", "#445566")])
    return cand(spark, d).join(parties, "party").groupBy("label", "color").agg(F.count("*").alias("n"))


@bound("""SELECT n_nationkey AS id, n_name AS name FROM nation""")
def optional_files(spark, d):
    """A file that is there and one that isn't, read the same way."""
    path = files.scratch(spark, "json")
    files.write_json(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), path)
    read = lambda p: files.json_rows(spark, p, "id long, name string", arrays=False, optional=True)
    return read(path).union(read(f"{path}-absent"))


@bound(f"""WITH {V_CAND} SELECT id, name FROM cand ORDER BY name, id LIMIT 30 OFFSET 30""")
def name_page(spark, d):
    c = cand(spark, d)
    return keys.paged(c, people.sorted_by(c, "name-asc"), 2, 30).select("id", "name")


_TITLES, _FIRSTS = {r"\brod\b": "title"}, {"first": ["blue", "cold"]}
part("classes_with_veto", lambda: F.coalesce(scalar.listed_class(F.col("p_name"), _TITLES, _FIRSTS, ("gear", "anvil")), F.lit("")), "CASE WHEN p_name LIKE '% rod' THEN 'title' WHEN split_part(p_name, ' ', 1) IN ('blue', 'cold') AND split_part(p_name, ' ', 2) NOT IN ('gear', 'anvil') THEN 'first' ELSE '' END")
_VOTES = [(1e5, 2, " L"), (1e3, 1, "K")]
_FIX = "CAST(CAST(floor(v / {0} * {1} + 0.5) / {1} AS DECIMAL(20, {2})) AS VARCHAR)"
part("vote_texts", lambda: scalar.short_number(F.col("p_partkey") * 977 % 400000 * (F.col("p_size") % 4), _VOTES), f"(SELECT CASE WHEN v = 0 THEN '—' WHEN v >= 100000 THEN {_FIX.format('1e5', 100, 2)} || ' L' WHEN v >= 1000 THEN {_FIX.format('1e3', 10, 1)} || 'K' ELSE CAST(v AS VARCHAR) END FROM (SELECT p_partkey * 977 % 400000 * (p_size % 4) AS v))")
part("crore_texts", lambda: scalar.crores(F.col("p_partkey") * 37 % 5000 * (F.col("p_size") % 3), "₹0 (refused)"), f"(SELECT CASE WHEN v >= 1000 THEN '₹' || {_FIX.format('1e3', 10, 1)} || 'K Cr' WHEN v > 0 THEN '₹' || v || ' Cr' ELSE '₹0 (refused)' END FROM (SELECT p_partkey * 37 % 5000 * (p_size % 3) AS v))")
part("percent_texts", lambda: scalar.percent_text(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 8)), f"CASE WHEN p_size % 5 = 0 THEN '—' ELSE (SELECT {_FIX.format('1', 10, 1)} FROM (SELECT p_size / 8.0::DOUBLE AS v)) || '%' END")

_AT = "2024-01-20 00:00:00"
_AGE = f"(SELECT CASE WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE {{}} END FROM (SELECT CAST(epoch(TIMESTAMP '{_AT}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s))"
event("ages_in_days", lambda: scalar.age_text(F.least(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit(_AT))), F.to_timestamp(F.lit(_AT)), just_now=False), _AGE.format("s // 86400 || 'd ago'").replace("epoch(ts)", f"epoch(least(ts, TIMESTAMP '{_AT}'))"))
event("ages_or_dates", lambda: scalar.age_text(F.least(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit(_AT))), F.to_timestamp(F.lit(_AT)), dates=True), _AGE.format("strftime(ts, '%-d/%-m/%Y')").replace("CASE WHEN s < 3600", "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600").replace("epoch(ts)", f"epoch(least(ts, TIMESTAMP '{_AT}'))"))


# ---------------------------------------------------------------- read queries


def _dims(spark, d):
    parties = spark.createDataFrame([("BUILDING", "Builders"), ("MACHINERY", "Makers")], "id string, name string")
    return cand(spark, d).withColumn("contest", F.col("ac").cast("string")), parties, table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))


@bound(f"""WITH {V_CAND} SELECT CAST(id AS VARCHAR) AS id, n_name AS contest, 'Builders' AS party, count(*) OVER () AS total FROM cand JOIN nation ON ac = n_nationkey WHERE party = 'BUILDING'""")
def api_candidates(spark, d):
    out = api.candidates(*_dims(spark, d), party="BUILDING")
    return out.select(F.get_json_object("data", "$.id").alias("id"), F.get_json_object("data", "$.contest_info.name").alias("contest"), F.get_json_object("data", "$.party_info.name").alias("party"), "total")


@bound(f"""WITH {V_CAND} SELECT id, n_name AS contest, CASE party WHEN 'BUILDING' THEN 'Builders' WHEN 'MACHINERY' THEN 'Makers' ELSE '' END AS party FROM cand JOIN nation ON ac = n_nationkey WHERE id = 7""")
def api_candidate(spark, d):
    return api.candidate(*_dims(spark, d), wanted=7).select("id", F.col("contest_info.name").alias("contest"), F.coalesce("party_info.name", F.lit("")).alias("party"))


@bound("""SELECT CAST(n_nationkey AS VARCHAR) AS id, count(*) OVER () AS total FROM nation WHERE (contains(lower(n_name), '1') OR contains(n_name, '1')) AND n_regionkey = 1""")
def api_contests(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("name_bn"), F.col("n_regionkey").cast("string").alias("district"))
    return api.contests(n, "1", "1").select(F.get_json_object("data", "$.id").alias("id"), "total")


_TIERS, _CLASSES = ["None", "School", "Graduate", "Post Graduate", "Doctorate"], ["Low", "Medium", "High", "Very High"]


@bound(f"""WITH {V_CAND}, own AS (SELECT * FROM tiered WHERE ac = 3), s AS (SELECT count(*) AS n, count(*) FILTER (cases > 0) AS c, avg(CAST(assets AS DOUBLE)) AS a, median(assets) AS m, count(*) FILTER (gender = 'Female') AS f, count(*) FILTER (gender IS NULL OR gender NOT IN ('Female', 'Other')) AS h,
floor(CAST(sum((age > 0)::INT + (education NOT IN ('', 'Not declared'))::INT + ({V_JOB} NOT IN ('', 'Not declared'))::INT + (assets <> 0)::INT + (url <> '')::INT + (gender IS NOT NULL)::INT) AS DOUBLE) / (count(*) * 6) * 100 + 0.5) AS q FROM own)
SELECT 'figure' AS kind, unnest(['n', 'with_cases', 'avg_assets', 'median_assets', 'women', 'men', 'others', 'quality']) AS name, unnest([n, c, floor(a + 0.5), m, f, h, 0, q]) AS value FROM s
UNION ALL SELECT 'education', b, CAST((SELECT count(*) FROM own WHERE {_TIERS!r}[tier + 1] = b) AS DOUBLE) FROM (SELECT unnest({_TIERS!r}) AS b)
UNION ALL SELECT 'assets', b, CAST((SELECT count(*) FROM own WHERE bucket = b) AS DOUBLE) FROM (SELECT unnest({_CLASSES!r}) AS b)
UNION ALL SELECT 'fact', 'clean-record', floor(CAST(count(*) FILTER (cases = 0) AS DOUBLE) / count(*) * 100 + 0.5) FROM own UNION ALL SELECT 'fact', 'party-count', CAST(count(DISTINCT party) AS DOUBLE) FROM own""")
def api_insights(spark, d):
    """One contest's whole answer as rows; of the facts, which fun_facts_ac holds to SQL one by one, the two that are always there."""
    figures, histograms, facts = api.insights(cand(spark, d).withColumn("contest", F.col("ac")).withColumn("occupation", job()), 3)
    figures = figures.withColumn("avg_assets", scalar.half_up("avg_assets"))
    names = ["n", "with_cases", "avg_assets", "median_assets", "women", "men", "others", "quality"]
    rows = figures.select(F.explode(F.array(*[F.struct(F.lit("figure").alias("kind"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    bars = histograms.select(F.col("of").alias("kind"), F.col("bucket").alias("name"), F.col("n").cast("double").alias("value"))
    said_of = facts.where(F.col("kind").isin("clean-record", "party-count")).select(F.lit("fact").alias("kind"), F.col("kind").alias("name"), "value")
    return rows.union(bars).union(said_of)


@bound(f"""WITH {V_CUST.format(size=100)}, p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k) AS place FROM c) SELECT 'contest' AS kind, url, name AS title FROM p WHERE place <= 10 UNION ALL SELECT 'all', url, name FROM p WHERE place <= 6""")
def api_news(spark, d):
    made = pages_of(customers(spark, d), F.col("url"), ["k"], said("<item><title>%s</title><link>https://news.example/%d</link></item>", "name", "k"))
    shown = lambda kind, one: api.news(made, one).select(F.lit(kind).alias("kind"), "url", "title")
    return shown("contest", True).union(shown("all", False))


@bound(f"""WITH {V_DOCS} SELECT count(*) AS contests, count(*) FILTER (declared) AS declared, 'ok' AS status FROM docs""")
def api_live_state(spark, d):
    summary, meta = plan.run(_docs(spark, d), _before(spark, d), F.lit("t1"))
    return api.live_state(summary, meta).select("contests", "declared", "status")


@bound(f"""WITH {V_DOCS} SELECT id, leader, margin FROM docs WHERE id = 4""")
def api_live_result(spark, d):
    return api.live_result(_docs(spark, d), 4).select("id", "leader", "margin")


# ---------------------------------------------------------------- streams


def _events(e):
    return e.select(F.col("user_id").alias("key"), "event_id", "ts", F.col("event_type").alias("party"), "value", (F.col("event_type") == "purchase").alias("declared"))


def _landed(spark, d):
    """The events as snapshots that have landed."""
    return _events(landed(spark, f"{d}/events*.parquet", table(spark, d, "events").schema))


def _schema(stream) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)


class _Halves:
    """The events, landed half by half: first those with an even number."""

    def __init__(self, spark, d) -> None:
        self.spark, self.events = spark, table(spark, d, "events")
        self.folder, self.progress, self.at = files.scratch(spark, "landing"), files.scratch(spark, "progress"), 0

    def land(self, each) -> None:
        self.events.where(F.col("event_id") % 2 == self.at).write.mode("append").parquet(self.folder)
        self.at += 1
        run_available(_events(landed(self.spark, self.folder, self.events.schema)), self.progress, each)


def _newest(where: str = "true") -> str:
    return f"(SELECT user_id AS key, event_id, event_type AS party, event_type = 'purchase' AS declared, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {where}) WHERE r = 1)"


V_LAST = f"last AS (SELECT key, event_id, party FROM {_newest()})"


def _state(spark, d, **more) -> State:
    return latest_state(spark, files.scratch(spark, "latest"), _schema(_events(table(spark, d, "events"))), "key", "ts", "event_id", **more)


def _latest(spark, d) -> State:
    state = _state(spark, d)
    run_available(_landed(spark, d), files.scratch(spark, "progress"), upsert_latest(state, "ts", "event_id"))
    return state


_SHOWN = ("key", "event_id", "party")


@bound(f"""WITH {V_LAST} SELECT * FROM last""")
def stream_latest(spark, d):
    return _latest(spark, d).read().select(*_SHOWN)


@bound(f"""WITH {V_LAST} SELECT * FROM last WHERE party <> 'purchase'""")
def stream_keys_dropped(spark, d):
    """The state after every declared key is deleted from it."""
    state = _latest(spark, d)
    state.drop_keys(state.read().where("declared"))
    return state.read().select(*_SHOWN)


@bound(f"""WITH a AS {_newest("event_id % 2 = 0")}, b AS {_newest("event_id % 2 = 1")}, w AS {_newest()}
SELECT key, event_id, party FROM w WHERE key NOT IN (SELECT key FROM a WHERE declared) UNION ALL SELECT key, event_id, party FROM b WHERE key IN (SELECT key FROM a WHERE declared)""")
def stream_dropped_then_landed(spark, d):
    """Keys that are declared after the first half are deleted; the second half starts them anew and brings no other back."""
    state, halves = _state(spark, d), _Halves(spark, d)
    halves.land(upsert_latest(state, "ts", "event_id"))
    state.drop_keys(state.read().where("declared"))
    halves.land(upsert_latest(state, "ts", "event_id"))
    return state.read().select(*_SHOWN)


@bound(f"""WITH {V_LAST} SELECT * FROM last""")
def stream_two_writers(spark, d):
    """Four writers land a quarter of the events each at the same time, and each of them twice."""
    state = _state(spark, d)
    own = _events(table(spark, d, "events"))

    def land(part: int) -> None:
        quarter = live.latest(own.where(F.col("event_id") % 4 == part), "key", "ts", "event_id")
        for _ in range(2):
            State(spark, state.folder, _schema(own), "key", state.merge).commit(quarter, source=f"writer {part}", batch=0)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(land, range(4)))
    return state.read().select(*_SHOWN)


@bound(f"""WITH w AS {_newest()}, now AS (SELECT max(ts) AS t FROM events) SELECT key, event_id, party FROM w, now WHERE ts + to_hours(CAST(event_id % 40 + 1 AS INT)) > t""")
def stream_expired(spark, d):
    """A row lasts one to forty hours of the data's own clock."""
    kind = table(spark, d, "events").schema["ts"].dataType
    lasting = lambda e: e.withColumn("until", (F.col("ts") + F.make_interval(hours=F.col("event_id") % 40 + 1)).cast(kind))
    state = latest_state(spark, files.scratch(spark, "lasting"), _schema(lasting(_events(table(spark, d, "events")))), "key", "ts", "event_id", until="until")
    land = upsert_latest(state, "ts", "event_id")
    run_available(lasting(_landed(spark, d)), files.scratch(spark, "progress"), land)
    return state.read().select(*_SHOWN)


@bound(f"""WITH w AS {_newest()} SELECT key, event_id, CASE WHEN key % 3 = 0 THEN 'set by hand' ELSE party END AS party, CASE WHEN key % 3 = 0 AND key % 2 = 0 THEN -1 ELSE value END AS value FROM w""")
def stream_patched(spark, d):
    """Columns of every third key are set in place; keys that the state doesn't hold stay out."""
    state = _latest(spark, d)
    keys_ = state.read().select("key").union(spark.range(10**9, 10**9 + 5).select("id"))
    state.patch(keys_.where("key % 3 = 0").select("key", F.lit("set by hand").alias("party"), F.when(F.col("key") % 2 == 0, -1.0).alias("value")))
    return state.read().select(*_SHOWN, "value")


@bound(f"""WITH w AS {_newest("value >= 0 AND event_type <> 'error'")} SELECT key, event_id, party FROM w""")
def stream_last_good(spark, d):
    """Rows that can't be right leave the last good row of their key."""
    state = _state(spark, d)
    good = (F.col("value") >= 0) & (F.col("party") != "error")
    run_available(_landed(spark, d), files.scratch(spark, "progress"), upsert_latest(state, "ts", "event_id", good=good))
    return state.read().select(*_SHOWN)


def _run(spark, d, state, half: int, **how):
    rows = _events(table(spark, d, "events").where(F.col("event_id") % 2 == half)).withColumn("key", F.when(F.col("key") % 7 != 0, F.col("key")))
    return plan.scheduled(state, rows, how.pop("phase", "live"), half, "ts", "event_id", **how)


@bound("""WITH e AS (SELECT event_id % 2 AS half, user_id % 7 = 0 AS lost, user_id FROM events), h AS (SELECT half, count(*) AS rows, count(*) FILTER (lost) AS unmatched FROM e GROUP BY half)
SELECT 'skipped' AS status, 0 AS reset, 0 AS rows, 0 AS unmatched, 0 AS written UNION ALL SELECT 'dry', 0, rows, unmatched, 0 FROM h WHERE half = 0 UNION ALL SELECT 'partial', 0, rows, unmatched, rows - unmatched FROM h WHERE half = 0
UNION ALL SELECT 'partial', (SELECT count(DISTINCT user_id) FROM e WHERE half = 0 AND NOT lost), rows, unmatched, rows - unmatched FROM h WHERE half = 1""")
def scheduled_runs(spark, d):
    """A run outside the live phase, a dry one, a real one, and one that resets before it writes."""
    state = _state(spark, d)
    made = [_run(spark, d, state, 0, phase="pre"), _run(spark, d, state, 0, dry=True), _run(spark, d, state, 0), _run(spark, d, state, 1, reset=True)]
    return made[0].union(made[1]).union(made[2]).union(made[3])


@bound(f"""WITH b AS {_newest("event_id % 2 = 1")} SELECT key, event_id, party FROM b WHERE key % 7 <> 0""")
def run_after_reset(spark, d):
    """What a run that resets leaves is its own rows."""
    state = _state(spark, d)
    _run(spark, d, state, 0)
    _run(spark, d, state, 1, reset=True)
    return state.read().select(*_SHOWN)


_SUMS = {"declared": lambda r: r["declared"].cast("long"), "votes": lambda r: F.floor(F.abs(r["value"]))}


def _summarised(spark, d) -> Summary:
    """The totals after both halves and a deletion, each taken in as a change."""
    state, halves = latest_state(spark, files.scratch(spark, "latest"), _schema(_events(table(spark, d, "events"))) + ", margin long", "key", "ts", "event_id"), _Halves(spark, d)
    summary = Summary(state, files.scratch(spark, "totals"), "party", _SUMS, "margin", lambda r: r["margin"] > 0)

    def each(batch, number: int) -> None:
        upsert_latest(state, "ts", "event_id")(batch.withColumn("margin", F.floor(F.abs("value"))), number)
        summary.update(state.version_of("stream", number))

    halves.land(each)
    summary.update(state.drop_keys(state.read().where("key % 5 = 0")))
    halves.land(each)
    return summary


V_SUMMED = f"""b AS {_newest("event_id % 2 = 1")}, w AS {_newest()}, s AS (SELECT * FROM w WHERE key % 5 <> 0 UNION ALL SELECT * FROM b WHERE key % 5 = 0)"""


@bound(f"""WITH {V_SUMMED} SELECT party, count(*) AS contests, count(*) FILTER (declared) AS declared, CAST(sum(floor(abs(value))) AS BIGINT) AS votes FROM s GROUP BY party""")
def stream_totals(spark, d):
    return _summarised(spark, d).read()


@bound(f"""WITH {V_SUMMED} SELECT key, CAST(floor(abs(value)) AS BIGINT) AS margin FROM s WHERE floor(abs(value)) > 0 ORDER BY margin, key LIMIT 10""")
def stream_tightest(spark, d):
    return spark.createDataFrame([(i, m) for m, i in _summarised(spark, d).tightest()], "key long, margin long")


@bound("""WITH e AS (SELECT user_id AS key, ts, event_id, event_type = 'purchase' AS dec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (SELECT key, coalesce(max(i) FILTER (NOT dec), 0) AS broke FROM e GROUP BY 1)
SELECT key, max(event_id) FILTER (i = n) AS last_event, min(ts) FILTER (dec AND i > broke) AS declared_at FROM (SELECT *, max(i) OVER (PARTITION BY key) AS n FROM e) JOIN b USING (key) GROUP BY key HAVING declared_at IS NOT NULL""")
def stream_first_seen(spark, d):
    stream = _landed(spark, d)
    state = first_seen_state(spark, files.scratch(spark, "seen"), "key", "long", stream.schema["ts"].dataType.simpleString(), "long")
    run_available(stream, files.scratch(spark, "progress"), first_seen(state, "ts", "declared", "event_id"))
    return state.read().where("declared_at is not null").select("key", F.col("last_tie").alias("last_event"), "declared_at")


@bound("""WITH p AS (SELECT l_orderkey AS run, l_linenumber AS page, CASE WHEN l_partkey % 6 = 0 THEN 404 ELSE 200 END AS status FROM lineitem WHERE l_suppkey % 11 <> 0), n AS (SELECT run, page FROM p WHERE status = 200),
f AS (SELECT run, page, row_number() OVER (PARTITION BY run ORDER BY page) AS place FROM (SELECT DISTINCT run, page FROM n WHERE (run, page) NOT IN (SELECT run, page FROM p WHERE status <> 200)))
SELECT run, page FROM f WHERE page = place AND page <= 5""")
def pages_before_failure(spark, d):
    """Pages of a run up to the first that failed or never landed, five at most."""
    l = table(spark, d, "lineitem").where("l_suppkey % 11 <> 0").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("int").alias("page"), F.when(F.col("l_partkey") % 6 == 0, 404).otherwise(200).alias("status"))
    return pages_until_failure(l, limit=5).select("run", F.col("page").cast("long").alias("page")).distinct()


# ---------------------------------------------------------------- keyed storage


_WANTED = [7 * i + 1 for i in range(40)]


@bound(f"""SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey IN ({", ".join(map(str, _WANTED))})""")
def keyed_point_reads(spark, d):
    """All orders in folders by a hash of their key; a few are read from the folders they lie in."""
    path = files.scratch(spark, "keyed")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    keyed.write(orders, path, "key", 16)
    return keyed.read(spark, path, "key", _WANTED)


@bound("""SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 30 OFFSET 3000""")
def sorted_page(spark, d):
    """Page 101 of the orders by price, read from the ranges that hold it."""
    path = files.scratch(spark, "sorted")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("price"))
    keyed.write_sorted(orders, path, [F.desc("price"), F.asc("key")], 32)
    return keyed.page(spark, path, 101, 30)


@bound(f"""WITH {V_CAND} SELECT party, count(*) AS n FROM cand WHERE id % 2 = 0 GROUP BY party""")
def policy_view(spark, d):
    """A published table shows what its policy lets through, whatever a reader asks."""
    keyed.publish(cand(spark, d).withColumn("is_active", F.col("id") % 2 == 0), "open_contestants", F.col("is_active"))
    return spark.sql("SELECT party, count(*) AS n FROM open_contestants GROUP BY party")
