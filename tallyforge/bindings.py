"""The operators bound to the harness tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import profile, scalar
from tallyforge.functions.scalar import half_up, percent, ratio
from tallyforge.operators import contest, keys, listing, live, matching, people, quiz, search
from tallyforge.sources import pages as web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def bound(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- views

EDUCATION = ["PhD in History", "Post Graduate", "PG Diploma", "Graduate Professional", "12th Pass", "10th Pass", "Literate", "Not declared"]
MAJORS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]


def votes(spark: SparkSession, d: str, year: int | None = None) -> DataFrame:
    """(ac, district, yr, party, votes): orders by nation, year and market segment."""
    o = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    if year:
        o = o.where(F.year("o_orderdate") == year)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    v = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", "yr", F.col("c_mktsegment").alias("party")).agg(F.sum(F.floor("o_totalprice")).alias("votes"))
    return v.join(n, v["c_nationkey"] == n["n_nationkey"]).select(F.col("n_nationkey").cast("long").alias("ac"), F.col("n_regionkey").cast("long").alias("district"), "yr", "party", "votes")


V_VOTES = """votes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS ac, CAST(n_regionkey AS BIGINT) AS district, CAST(year(o_orderdate) AS BIGINT) AS yr, c_mktsegment AS party,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS votes
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def fine(spark: SparkSession, d: str) -> DataFrame:
    """(ac, party, votes): one contest per order, suppliers' nations as parties."""
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    j = l.join(s, l["l_suppkey"] == s["s_suppkey"])
    return j.groupBy(F.col("l_orderkey").alias("ac"), F.col("s_nationkey").cast("long").alias("party")).agg(F.sum(F.floor("l_extendedprice")).alias("votes"))


V_FINE = """fine AS (
  SELECT l_orderkey AS ac, CAST(s_nationkey AS BIGINT) AS party, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS votes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def cand(spark: SparkSession, d: str) -> DataFrame:
    """Contestants made of customers."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("long").alias("ac"),
        F.col("c_mktsegment").alias("party"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10000).alias("assets"),
        F.floor(F.greatest(-F.col("c_acctbal"), F.lit(0.0)) * 10000).alias("liabilities"),
        F.when(k % 29 == 0, 21).otherwise(k % 7).cast("long").alias("cases"),
        F.when(k % 11 == 0, 0).otherwise(18 + k % 60).cast("long").alias("age"),
        F.when(k % 3 == 0, "Female").when(k % 3 == 1, "Male").alias("gender"),
        F.element_at(F.array(*[F.lit(e) for e in EDUCATION]), (k % 8 + 1).cast("int")).alias("education"),
        (k % 13 == 0).alias("incumbent"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("url"),
        F.concat_ws("|", F.col("c_name"), F.col("c_nationkey").cast("string")).alias("place"),
    )


def job() -> Column:
    return F.when(F.col("id") % 4 == 0, "Not declared").when(F.col("id") % 9 == 0, "").otherwise("Farmer")


V_JOB = "CASE WHEN id % 4 = 0 THEN 'Not declared' WHEN id % 9 = 0 THEN '' ELSE 'Farmer' END"
V_CAND = f"""cand AS (
  SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS ac, c_mktsegment AS party,
         CAST(floor(greatest(c_acctbal, 0) * 10000) AS BIGINT) AS assets, CAST(floor(greatest(-c_acctbal, 0) * 10000) AS BIGINT) AS liabilities,
         CAST(CASE WHEN c_custkey % 29 = 0 THEN 21 ELSE c_custkey % 7 END AS BIGINT) AS cases,
         CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 18 + c_custkey % 60 END AS BIGINT) AS age,
         CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS gender,
         {EDUCATION!r}[c_custkey % 8 + 1] AS education, c_custkey % 13 = 0 AS incumbent,
         CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'u' || c_custkey END AS url
  FROM customer), tiered AS (
  SELECT *, CASE education WHEN 'PhD in History' THEN 4 WHEN 'Post Graduate' THEN 3 WHEN 'PG Diploma' THEN 3 WHEN 'Graduate Professional' THEN 2 WHEN '12th Pass' THEN 1 WHEN '10th Pass' THEN 1 ELSE 0 END AS tier,
         greatest(0, least(100, 100 - least(cases * 15, 60) + 5 * (CASE education WHEN 'PhD in History' THEN 4 WHEN 'Post Graduate' THEN 3 WHEN 'PG Diploma' THEN 3 WHEN 'Graduate Professional' THEN 2 WHEN '12th Pass' THEN 1 WHEN '10th Pass' THEN 1 ELSE 0 END)
           + CASE WHEN url <> '' THEN 5 ELSE 0 END)) AS integrity,
         CASE WHEN assets < 1000000 THEN 'Low' WHEN assets < 10000000 THEN 'Medium' WHEN assets < 100000000 THEN 'High' ELSE 'Very High' END AS bucket
  FROM cand)"""

WON = """won AS (
  SELECT *, CASE WHEN total > 0 THEN CAST(votes AS DOUBLE) / CAST(total AS DOUBLE) * 100 ELSE 0 END AS share, votes - coalesce(next_votes, 0) AS margin
  FROM (SELECT *, row_number() OVER (PARTITION BY ac, yr ORDER BY votes DESC, party) AS place, lead(votes) OVER (PARTITION BY ac, yr ORDER BY votes DESC, party) AS next_votes,
               CAST(sum(votes) OVER (PARTITION BY ac, yr) AS BIGINT) AS total FROM votes) WHERE place = 1)"""
BEFORE, NOW = 1999, 2000


def won(spark: SparkSession, d: str, year: int) -> DataFrame:
    return contest.winners(votes(spark, d, year), ["ac", "yr"], order=["party"])


# ---------------------------------------------------------------- contests


@bound(f"""WITH {V_VOTES}, {WON}, p AS (SELECT party, count(*) AS seats_prev FROM won WHERE yr = {BEFORE} GROUP BY 1),
n AS (SELECT party, count(*) AS seats_now FROM won WHERE yr = {NOW} GROUP BY 1), c AS (SELECT party, count(*) AS contested FROM votes WHERE yr = {NOW} GROUP BY 1)
SELECT party, coalesce(seats_prev, 0) AS seats_prev, coalesce(seats_now, 0) AS seats_now, coalesce(seats_now, 0) - coalesce(seats_prev, 0) AS delta, coalesce(contested, 0) AS contested,
 CASE WHEN coalesce(contested, 0) > 0 THEN CAST(coalesce(seats_now, 0) AS DOUBLE) / CAST(contested AS DOUBLE) ELSE 0 END AS strike_rate
FROM p FULL JOIN n USING (party) FULL JOIN c USING (party)""")
def party_scorecard(spark, d):
    rows = votes(spark, d, NOW)
    out = contest.scorecard(won(spark, d, BEFORE), won(spark, d, NOW), rows).drop("avg_share")
    return out.orderBy(F.desc("seats_now"), F.desc("seats_prev"), "party")


@bound(f"""WITH {V_VOTES}, {WON} SELECT a.ac, a.party AS from_party, b.party AS to_party, b.margin, a.party = b.party AS same_party
FROM won a JOIN won b ON a.ac = b.ac WHERE a.yr = {BEFORE} AND b.yr = {NOW}""")
def seat_flips(spark, d):
    return contest.seat_flips(won(spark, d, BEFORE), won(spark, d, NOW), ["ac"])


@bound(f"""WITH {V_VOTES}, {WON}, f AS (SELECT a.party AS fp, b.party AS tp FROM won a JOIN won b ON a.ac = b.ac WHERE a.yr = {BEFORE} AND b.yr = {NOW}),
x AS (SELECT tp AS party, 1 AS r, 0 AS g, 0 AS l FROM f WHERE fp = tp UNION ALL SELECT tp, 0, 1, 0 FROM f WHERE fp <> tp UNION ALL SELECT fp, 0, 0, 1 FROM f WHERE fp <> tp)
SELECT party, CAST(sum(r) AS BIGINT) AS retained, CAST(sum(g) AS BIGINT) AS gained, CAST(sum(l) AS BIGINT) AS lost, CAST(sum(g) - sum(l) AS BIGINT) AS delta FROM x GROUP BY 1""")
def retained_gained_lost(spark, d):
    return contest.retention(won(spark, d, BEFORE), won(spark, d, NOW), ["ac"])


@bound(f"""WITH {V_VOTES}, {WON} SELECT a.party AS from_party, b.party AS to_party, count(*) AS moved FROM won a JOIN won b ON a.ac = b.ac
WHERE a.yr = {BEFORE} AND b.yr = {NOW} AND a.party <> b.party GROUP BY ALL""")
def swing_pairs(spark, d):
    return contest.swing_delta(contest.seat_flips(won(spark, d, BEFORE), won(spark, d, NOW), ["ac"]))


@bound(f"""WITH {V_FINE} SELECT ac, party, votes, margin, total, floor(CAST(votes AS DOUBLE) / CAST(total AS DOUBLE) * 100 * 100 + 0.5) / 100 AS share FROM (
SELECT *, votes - coalesce(lead(votes) OVER w, 0) AS margin, row_number() OVER w AS place, CAST(sum(votes) OVER (PARTITION BY ac) AS BIGINT) AS total FROM fine WINDOW w AS (PARTITION BY ac ORDER BY votes DESC, party)) WHERE place = 1""")
def leader_margin_share(spark, d):
    return contest.winners(fine(spark, d), ["ac"], order=["party"]).select("ac", "party", "votes", "margin", "total", half_up("share", 2).alias("share"))


@bound(f"""WITH {V_FINE} SELECT ac, party, margin FROM (SELECT *, votes - coalesce(lead(votes) OVER w, votes) AS margin, row_number() OVER w AS place FROM fine
WINDOW w AS (PARTITION BY ac ORDER BY votes DESC, party)) WHERE place = 1 AND margin > 0 ORDER BY margin, ac LIMIT 10""")
def tightest_10(spark, d):
    return live.tightest(contest.winners(fine(spark, d), ["ac"], order=["party"], single="zero"), 10, tie="ac").select("ac", "party", "margin")


@bound(f"""WITH {V_FINE} SELECT ac, party, margin FROM (SELECT *, votes - coalesce(lead(votes) OVER w, 0) AS margin, row_number() OVER w AS place FROM fine
WINDOW w AS (PARTITION BY ac ORDER BY votes DESC, party)) WHERE place = 1 ORDER BY margin DESC, ac LIMIT 10""")
def landslide_top(spark, d):
    return contest.winners(fine(spark, d), ["ac"], order=["party"]).orderBy(F.desc("margin"), "ac").limit(10).select("ac", "party", "margin")


@bound(f"""WITH {V_VOTES}, {WON}, l AS (SELECT party, count(*) AS seats FROM won WHERE yr = {NOW} GROUP BY 1), v AS (SELECT party, CAST(sum(votes) AS BIGINT) AS votes FROM votes WHERE yr = {NOW} GROUP BY 1)
SELECT party, coalesce(l.seats, 0) AS seats, coalesce(v.votes, 0) AS votes FROM l FULL JOIN v USING (party)""")
def state_summary_by_party(spark, d):
    return live.summary_by_party(won(spark, d, NOW), votes(spark, d, NOW)).withColumnRenamed("leading", "seats")


@bound(f"""WITH {V_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY ac, yr ORDER BY party) AS place FROM votes WHERE party <> 'MACHINERY')
SELECT ac, yr, max(CASE WHEN place = 1 THEN party END) AS winner, max(CASE WHEN place = 2 THEN party END) AS runner_up,
 (SELECT CAST(sum(votes) AS BIGINT) FROM votes v WHERE v.ac = r.ac AND v.yr = r.yr) AS total_votes,
 max(CASE WHEN place = 1 THEN votes END) - coalesce(max(CASE WHEN place = 2 THEN votes END), 0) AS margin_votes FROM r GROUP BY ac, yr""")
def historical_result(spark, d):
    out = contest.historical_result(votes(spark, d), ["ac", "yr"], "party", "party", F.col("party") == "MACHINERY")
    return out.select("ac", "yr", "winner", "runner_up", "total_votes", "margin_votes")


@bound(f"""WITH {V_VOTES}, {WON}, n AS (SELECT * FROM won WHERE yr = {NOW}), b AS (SELECT * FROM won WHERE yr = {BEFORE}), big AS (SELECT * FROM n ORDER BY margin DESC, ac LIMIT 1), small AS (SELECT * FROM n ORDER BY margin, ac LIMIT 1)
SELECT 'biggest_margin' AS kind, ac, party, margin FROM big UNION ALL SELECT 'tightest_margin', ac, party, margin FROM small WHERE ac NOT IN (SELECT ac FROM big)
UNION ALL (SELECT 'incumbent_loss', n.ac, n.party, n.margin FROM n JOIN b USING (ac) WHERE n.party <> b.party AND b.party IN (SELECT party FROM votes v WHERE v.yr = {NOW} AND v.ac = n.ac) ORDER BY n.ac LIMIT 3)
UNION ALL (SELECT 'first_time_winner', ac, party, margin FROM n WHERE party NOT IN (SELECT party FROM b) ORDER BY ac LIMIT 3)""")
def notable_wins(spark, d):
    before = won(spark, d, BEFORE)
    return contest.notable_wins(votes(spark, d, NOW), won(spark, d, NOW), before, "ac", "party", before)


def _demo(spark, d):
    c = table(spark, d, "customer")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("ac")).agg(F.count("*").alias("suppliers"))
    g = c.groupBy(F.col("c_nationkey").cast("long").alias("ac")).agg(F.count("*").alias("people"), ratio(F.count_if(F.col("c_mktsegment") == "BUILDING"), F.count("*"), 100.0).alias("building"))
    return g.join(s, "ac", "left")


V_DEMO = """demo AS (SELECT CAST(c_nationkey AS BIGINT) AS ac, count(*) AS people, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100 AS building,
 (SELECT nullif(count(*), 0) FROM supplier WHERE s_nationkey = c_nationkey) AS suppliers FROM customer GROUP BY c_nationkey)"""


def _quartile(col: str) -> str:
    at = lambda q: f"(SELECT list_sort(list({col}))[CAST(floor(count({col}) * {q}) AS INT) + 1] FROM demo WHERE {col} IS NOT NULL)"
    return f"CASE WHEN {col} <= {at(0.25)} THEN 'Q1 (lowest)' WHEN {col} <= {at(0.5)} THEN 'Q2' WHEN {col} <= {at(0.75)} THEN 'Q3' ELSE 'Q4 (highest)' END"


@bound(f"""WITH {V_VOTES}, {WON}, {V_DEMO}, r AS (SELECT * FROM won LEFT JOIN demo USING (ac) WHERE yr = {NOW})
SELECT dimension, bucket, party, count(*) AS seats FROM (SELECT 'district' AS dimension, CAST(district AS VARCHAR) AS bucket, party FROM r
 UNION ALL SELECT 'people', {_quartile("people")}, party FROM r WHERE people IS NOT NULL UNION ALL SELECT 'building', {_quartile("building")}, party FROM r WHERE building IS NOT NULL
 UNION ALL SELECT 'suppliers', {_quartile("suppliers")}, party FROM r WHERE suppliers IS NOT NULL) GROUP BY ALL""")
def demographic_slices(spark, d):
    demo = _demo(spark, d)
    return contest.slices(won(spark, d, NOW).join(demo, "ac", "left"), ["district"], ["people", "building", "suppliers"], demo)


@bound("""WITH o AS (SELECT o_custkey AS district, o_orderkey AS contest, o_orderstatus AS party FROM orders)
SELECT district, min(party) AS party, count(*) AS reporting FROM o GROUP BY district HAVING count(*) >= 3 AND count(DISTINCT party) = 1""")
def district_sweep(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("district"), F.col("o_orderkey").alias("contest"), F.col("o_orderstatus").alias("party"))
    return contest.sweeps(o, o, "district", "contest", "party")


@bound("""WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS party, count(*) AS votes FROM supplier GROUP BY 1), t AS (SELECT sum(votes) AS total FROM s),
r AS (SELECT party, votes, CAST(votes AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS share, row_number() OVER (ORDER BY votes DESC, party) AS place FROM s, t)
SELECT CASE WHEN place > 4 AND share < 4 THEN 'Others' ELSE party END AS party, CAST(sum(votes) AS BIGINT) AS votes FROM r GROUP BY 1""")
def others_bucket(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("party")).agg(F.count("*").alias("votes"))
    t = s.agg(F.sum("votes").alias("_t"))
    shares = s.join(F.broadcast(t)).select("party", "votes", ratio("votes", "_t", 100.0).alias("share"))
    return contest.others_collapsed(shares, "party", "votes", "share", below=4.0).select("party", "votes")


@bound(f"""WITH {V_VOTES}, {WON}, x AS (SELECT ac, count(DISTINCT party) AS parties FROM won GROUP BY ac) SELECT parties, count(*) AS contests FROM x GROUP BY 1""")
def swing_history(spark, d):
    w = contest.winners(votes(spark, d), ["ac", "yr"], order=["party"])
    return w.groupBy("ac").agg(F.count_distinct("party").alias("parties")).groupBy("parties").agg(F.count("*").alias("contests"))


@bound(f"""WITH {V_VOTES}, {WON}, x AS (SELECT ac, party, seats - coalesce(p, 0) AS delta FROM (SELECT party, party AS ac, count(*) FILTER (yr = {NOW}) AS seats, count(*) FILTER (yr = {BEFORE}) AS p FROM won GROUP BY party))
(SELECT 'gainer' AS kind, party, delta FROM x WHERE delta > 0 ORDER BY delta DESC, party LIMIT 1) UNION ALL (SELECT 'loser', party, delta FROM x WHERE delta < 0 ORDER BY delta, party LIMIT 1)""")
def gainer_and_loser(spark, d):
    cards = contest.scorecard(won(spark, d, BEFORE), won(spark, d, NOW), votes(spark, d, NOW))
    return contest.extremes(cards.select("party", "delta"), "delta", "party")


@bound(f"""WITH {V_VOTES}, {WON} SELECT count(*) AS contests, count(*) FILTER (a.party <> b.party) AS lost, CAST(floor(CAST(count(*) FILTER (a.party <> b.party) AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS lost_pct,
CAST(floor(avg(CAST(b.margin AS DOUBLE)) + 0.5) AS BIGINT) AS avg_margin FROM won a JOIN won b ON a.ac = b.ac WHERE a.yr = {BEFORE} AND b.yr = {NOW} HAVING count(*) >= 3""")
def incumbent_loss(spark, d):
    f = contest.seat_flips(won(spark, d, BEFORE), won(spark, d, NOW), ["ac"])
    out = f.agg(F.count("*").alias("contests"), F.count_if(~F.col("same_party")).alias("lost"), half_up(F.avg(F.col("margin").cast("double"))).alias("avg_margin")).where("contests >= 3")
    return out.withColumn("lost_pct", percent("lost", "contests"))


@bound(f"""WITH {V_VOTES}, {WON}, s AS (SELECT party, count(*) AS seats FROM won WHERE yr = {NOW} GROUP BY 1) SELECT party, seats FROM s WHERE seats >= 6 ORDER BY seats DESC, party LIMIT 1""")
def majority_banner(spark, d):
    return contest.majority(won(spark, d, NOW).groupBy("party").agg(F.count("*").alias("seats")), 6)


@bound(f"""WITH {V_VOTES}, {WON}, s AS (SELECT district, party, count(*) AS seats FROM won WHERE yr = {NOW} GROUP BY ALL), t AS (SELECT party, row_number() OVER (ORDER BY sum(seats) DESC, party) AS r FROM s GROUP BY party)
SELECT district, {", ".join(f"coalesce(CAST(sum(seats) FILTER (r = {i}) AS BIGINT), 0) AS top_{i}" for i in range(1, 6))} FROM s LEFT JOIN t USING (party) GROUP BY district""")
def top_parties_matrix(spark, d):
    s = won(spark, d, NOW).groupBy("district", "party").agg(F.count("*").alias("seats"))
    t = s.groupBy("party").agg(F.sum("seats").alias("n")).orderBy(F.desc("n"), "party").limit(5).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "party")))
    wide = s.join(F.broadcast(t), "party", "left").groupBy("district").pivot("r", [1, 2, 3, 4, 5]).agg(F.sum("seats"))
    return wide.select("district", *[F.coalesce(str(i), F.lit(0)).alias(f"top_{i}") for i in range(1, 6)])


# ---------------------------------------------------------------- people


@bound(f"""WITH {V_CAND} SELECT id, tier, integrity, CAST(floor((id % 101) * 0.6 + integrity * 0.4 + 0.5) AS BIGINT) AS final, bucket FROM tiered""")
def integrity_score(spark, d):
    c = cand(spark, d).withColumn("integrity", profile.integrity(F.col("cases"), F.col("education"), F.col("url")))
    return c.select("id", profile.education_tier(F.col("education")).alias("tier"), "integrity", profile.final_score(F.col("id") % 101, F.col("integrity")).alias("final"), profile.asset_bucket(F.col("assets")).alias("bucket"))


@bound(f"""WITH {V_CAND}, r AS (SELECT id, CASE WHEN cases > 0 THEN '−' || least(cases * 15, 60) || ' for ' || cases || ' pending criminal case' || CASE WHEN cases > 1 THEN 's' ELSE '' END ELSE '' END AS penalty,
 concat_ws('; ', CASE WHEN tier > 0 THEN '+' || tier * 5 || ' for ' || ['10th/12th pass', 'Graduate', 'Post Graduate', 'PhD/Doctorate'][tier] || ' education' END, CASE WHEN url <> '' THEN '+5 for affidavit on public record' END) AS bonus FROM tiered)
SELECT id, penalty, CASE WHEN penalty = '' AND bonus = '' THEN 'Standard profile — no declared criminal cases' ELSE bonus END AS bonus FROM r""")
def score_breakdown(spark, d):
    minus, plus = profile.reasons(F.col("cases"), F.col("education"), F.col("url"))
    return cand(spark, d).select("id", F.array_join(minus, "; ").alias("penalty"), F.array_join(plus, "; ").alias("bonus"))


@bound(f"""WITH {V_CAND}, f AS (SELECT id, cases, assets, [CASE WHEN url = '' THEN 'Missing affidavit URL' END, CASE WHEN age < 18 THEN 'Age not declared or invalid' END, CASE WHEN education = 'Not declared' THEN 'Education not declared' END,
 CASE WHEN assets = 0 AND liabilities = 0 THEN 'Asset data not available' END, CASE WHEN cases > 20 THEN cases || ' pending criminal cases declared' END] AS x FROM cand)
SELECT id, array_to_string(list_filter(x, lambda v: v IS NOT NULL), '; ') AS flags, CASE WHEN cases > 20 THEN 'alert' WHEN len(list_filter(x, lambda v: v IS NOT NULL)) > 2 THEN 'warn' ELSE 'clean' END AS severity FROM f""")
def validation(spark, d):
    c = cand(spark, d).withColumn("x", profile.flags(*[F.col(n) for n in ("cases", "age", "education", "url", "assets", "liabilities")]))
    return c.select("id", F.array_join("x", "; ").alias("flags"), profile.severity(F.col("x"), F.col("cases"), F.col("assets")).alias("severity"))


@bound(f"""WITH {V_CAND} SELECT ac, count(*) AS n, count(*) FILTER (cases > 0) AS with_cases, count(*) FILTER (gender = 'Female') AS women, count(*) FILTER (incumbent) AS incumbents,
 CAST(floor(avg(CAST(assets AS DOUBLE)) + 0.5) AS BIGINT) AS avg_assets, median(assets) AS median_assets, count(*) FILTER (gender IS NULL OR gender NOT IN ('Female', 'Other')) AS men, count(*) FILTER (gender = 'Other') AS others,
 CAST(floor(CAST(sum((age > 0)::INT + (education NOT IN ('', 'Not declared'))::INT + ({V_JOB} NOT IN ('', 'Not declared'))::INT + (assets <> 0)::INT + (url <> '')::INT + (gender IS NOT NULL)::INT) AS DOUBLE) / (count(*) * 6) * 100 + 0.5) AS BIGINT) AS quality FROM cand GROUP BY ac""")
def ac_insights(spark, d):
    return people.insights(cand(spark, d).withColumn("occupation", job()), ["ac"]).withColumn("avg_assets", half_up("avg_assets")).drop("avg_age")


@bound(f"""WITH {V_CAND}, s AS (SELECT unnest(['None', 'School', 'Graduate', 'Post Graduate', 'Doctorate']) AS bucket), a AS (SELECT DISTINCT ac FROM cand)
SELECT a.ac, s.bucket, count(t.id) AS n FROM a CROSS JOIN s LEFT JOIN tiered t ON t.ac = a.ac AND ['None', 'School', 'Graduate', 'Post Graduate', 'Doctorate'][t.tier + 1] = s.bucket GROUP BY ALL""")
def edu_hist(spark, d):
    return people.education_histogram(cand(spark, d), ["ac"])


@bound(f"""WITH {V_CAND}, s AS (SELECT unnest(['Low', 'Medium', 'High', 'Very High']) AS bucket), a AS (SELECT DISTINCT ac FROM cand)
SELECT a.ac, s.bucket, count(t.id) AS n FROM a CROSS JOIN s LEFT JOIN tiered t ON t.ac = a.ac AND t.bucket = s.bucket GROUP BY ALL""")
def asset_hist(spark, d):
    return people.asset_histogram(cand(spark, d), ["ac"])


@bound(f"""WITH {V_CAND}, r AS (SELECT id, row_number() OVER (ORDER BY assets DESC, id) AS place, count(*) OVER () AS n FROM cand WHERE assets > 0)
SELECT id, place, CAST(floor((1 - CAST(place AS DOUBLE) / n) * 100 + 0.5) AS BIGINT) AS percentile FROM r""")
def wealth_rank(spark, d):
    c = cand(spark, d).where("assets > 0")
    n = c.agg(F.count("*").alias("n"))
    r = keys.ranked(c.select("id", "assets"), "assets", "id", "place").join(F.broadcast(n))
    return r.select("id", "place", half_up((1 - F.col("place").cast("double") / F.col("n")) * 100).alias("percentile"))


@bound(f"""WITH {V_CAND} SELECT ac, id, CAST(CASE WHEN assets > 0 THEN row_number() OVER (PARTITION BY ac ORDER BY assets DESC, id) END AS DOUBLE) AS place FROM cand""")
def wealth_rank_in_contest(spark, d):
    c = cand(spark, d).select("ac", "id", "assets")
    own = keys.placed(c.where("assets > 0"), ["ac"], -F.col("assets").cast("double"), [F.desc("assets"), F.col("id")])
    none = c.where("coalesce(assets, 0) <= 0").withColumn("place", F.lit(None).cast("double"))
    return own.withColumn("place", F.col("place").cast("double")).unionByName(none).select("ac", "id", "place")


@bound(f"""WITH {V_CAND}, g AS (SELECT ac, count(*) AS n, count(*) FILTER (cases > 0) AS hit FROM cand GROUP BY ac)
SELECT CAST(floor(sum(CAST(hit AS DOUBLE) / CAST(n AS DOUBLE)) / count(*) * 1000000 + 0.5) AS BIGINT) AS micro FROM g""")
def mean_of_rates(spark, d):
    g = cand(spark, d).groupBy("ac").agg(F.count("*").alias("n"), F.count_if(F.col("cases") > 0).alias("hit"))
    return people.mean_of_rates(g, "n", "hit").select(half_up(F.col("mean_rate") * 1000000).alias("micro"))


@bound(f"""WITH {V_CAND}, g AS (SELECT ac, count(*) AS n FROM cand GROUP BY ac), m AS (SELECT min(n) AS lo, max(n) AS hi FROM g)
SELECT ac, floor(CASE WHEN hi > lo THEN greatest(0, least(1, (CAST(n AS DOUBLE) - lo) / (hi - lo))) ELSE 0 END * 10000 + 0.5) / 10000 AS tone FROM g, m""")
def minmax_scale(spark, d):
    g = cand(spark, d).groupBy("ac").agg(F.count("*").alias("n"))
    m = g.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return g.join(F.broadcast(m)).select("ac", half_up(scalar.scaled("n", F.col("lo"), F.col("hi")), 4).alias("tone"))


@bound(f"""WITH {V_CAND} SELECT ac, count(*) AS n, count(DISTINCT party) FILTER (party IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')) AS majors, count(*) FILTER (cases > 0) AS criminal,
 floor((count(*) * 0.3 + count(DISTINCT party) FILTER (party IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')) * 15) * 10 + 0.5) / 10 AS score FROM cand GROUP BY ac""")
def hot_seats(spark, d):
    return people.hot_seats(cand(spark, d), "ac", MAJORS).withColumn("score", half_up("score", 1))


@bound(f"""WITH {V_CAND}, g AS (SELECT ac, count(*) AS n, arg_min(name, (-assets, id)) AS richest, max(assets) AS most, avg(CAST(assets AS DOUBLE)) AS mean, median(assets) AS med, arg_min(name, (-cases, id)) AS accused, max(cases) AS cases,
 count(*) FILTER (cases = 0) AS clean, arg_min(name, (age, id)) FILTER (age > 0) AS youngest, min(age) FILTER (age > 0) AS low, arg_min(name, (-age, id)) FILTER (age > 0) AS oldest, max(age) AS high,
 count(*) FILTER (gender = 'Female') AS women, arg_min(name, (-tier, id)) AS scholar, max(tier) AS tier, count(*) FILTER (incumbent) AS sitting, count(DISTINCT party) AS parties FROM tiered GROUP BY ac)
SELECT ac, 'wealthiest' AS kind, richest AS who, CAST(most AS DOUBLE) AS value FROM g WHERE most > 0 UNION ALL SELECT ac, 'most-cases', accused, cases FROM g WHERE cases > 0
UNION ALL SELECT ac, 'clean-record', NULL, floor(CAST(clean AS DOUBLE) / n * 100 + 0.5) FROM g UNION ALL SELECT ac, 'youngest', youngest, low FROM g WHERE low IS NOT NULL UNION ALL SELECT ac, 'oldest', oldest, high FROM g WHERE high <> low AND high > 0
UNION ALL SELECT ac, 'women', NULL, floor(CAST(women AS DOUBLE) / n * 100 + 0.5) FROM g WHERE women > 0 UNION ALL SELECT ac, 'most-educated', scholar, tier FROM g WHERE tier >= 3
UNION ALL SELECT ac, 'incumbents', NULL, sitting FROM g WHERE sitting > 0 UNION ALL SELECT ac, 'asset-spread', NULL, floor(mean / med * 10 + 0.5) / 10 FROM g WHERE med > 0 AND floor(mean / med * 10 + 0.5) / 10 > 1.5
UNION ALL SELECT ac, 'party-count', NULL, parties FROM g""")
def fun_facts_ac(spark, d):
    return people.facts(cand(spark, d), "ac")


@bound(f"""WITH {V_CAND}, sat AS (SELECT ac, id, 1 AS reason FROM cand WHERE incumbent),
rich AS (SELECT ac, arg_min(id, (-assets, id)) AS id, 2 AS reason FROM cand WHERE assets > 0 AND NOT incumbent GROUP BY ac), t2 AS (SELECT * FROM sat UNION ALL SELECT * FROM rich),
bad AS (SELECT ac, arg_min(id, (-cases, id)) AS id, 3 AS reason FROM cand WHERE cases > 0 AND id NOT IN (SELECT id FROM t2) GROUP BY ac), t3 AS (SELECT * FROM t2 UNION ALL SELECT * FROM bad),
maj AS (SELECT ac, min(id) AS id, 4 AS reason, CASE party WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS o FROM cand WHERE party IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') AND id NOT IN (SELECT id FROM t3) GROUP BY ac, party),
rest AS (SELECT ac, id, 5 AS reason, 0 AS o FROM cand WHERE id NOT IN (SELECT id FROM t3) AND id NOT IN (SELECT id FROM maj)),
every AS (SELECT ac, id, reason, 0 AS o FROM t3 UNION ALL SELECT ac, id, reason, o FROM maj UNION ALL SELECT * FROM rest)
SELECT ac, id, CAST(reason AS BIGINT) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY ac ORDER BY reason, o, id) AS place FROM every) WHERE reason <= 3 OR place <= 5""")
def greedy_faces(spark, d):
    return people.faces(cand(spark, d), "ac", MAJORS).select("ac", "id", "reason")


@bound(f"""WITH {V_CAND}, f AS (SELECT *, count(*) OVER () AS total FROM cand WHERE contains(lower(name), '00') AND party = 'BUILDING' AND cases > 0) SELECT id, name, assets, total FROM f ORDER BY assets DESC, id LIMIT 30 OFFSET 30""")
def facet_page(spark, d):
    f = people.facets(cand(spark, d), "00", party="BUILDING", cases_only=True)
    page = keys.paged(f, people.sorted_by(f, "assets-desc"), 2, 30)
    return page.join(F.broadcast(f.agg(F.count("*").alias("total")))).select("id", "name", "assets", "total")


@bound(f"""WITH {V_CAND}, f AS (SELECT party, count(*) AS funds FROM cand GROUP BY party), t AS (SELECT sum(funds) AS total, max(funds) AS top FROM f)
SELECT party, CAST(funds AS DOUBLE) / CAST(top AS DOUBLE) AS of_max, floor(CAST(funds AS DOUBLE) / CAST(total AS DOUBLE) * 100 * 10 + 0.5) / 10 AS pct,
 floor((CAST(coalesce(sum(funds) OVER (ORDER BY funds DESC, party ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(total AS DOUBLE) * 360 - 90) * 1000 + 0.5) / 1000 AS start FROM f, t""")
def running_share(spark, d):
    f = cand(spark, d).groupBy("party").agg(F.count("*").alias("funds"))
    return people.funding_shares(f, "funds").select("party", "of_max", "pct", half_up("start", 3).alias("start"))


@bound(f"""WITH {V_CAND}, w AS (SELECT * FROM (VALUES (1, 'a', 'BUILDING', 8), (1, 'a', 'MACHINERY', 2), (1, 'b', 'FURNITURE', 7), (2, 'a', 'BUILDING', 3), (2, 'b', 'AUTOMOBILE', 9)) t(question, option, party, weight)),
a AS (SELECT id AS session, q AS question, CASE WHEN (id + q) % 2 = 0 THEN 'a' ELSE 'b' END AS option FROM cand, (SELECT unnest([1, 2, 3]) AS q)), n AS (SELECT session, count(*) AS n FROM a GROUP BY 1)
SELECT session, party, CAST(floor(CAST(sum(weight) AS DOUBLE) / (n * 10) * 100 + 0.5) AS BIGINT) AS score FROM a JOIN w USING (question, option) JOIN n USING (session) GROUP BY session, party, n""")
def quiz_alignment(spark, d):
    w = spark.createDataFrame([(1, "a", "BUILDING", 8), (1, "a", "MACHINERY", 2), (1, "b", "FURNITURE", 7), (2, "a", "BUILDING", 3), (2, "b", "AUTOMOBILE", 9)], "question int, option string, party string, weight int")
    a = cand(spark, d).select(F.col("id").alias("session"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("question"))
    return quiz.alignment(a.withColumn("option", F.when((F.col("session") + F.col("question")) % 2 == 0, "a").otherwise("b")), w)


# ---------------------------------------------------------------- search and matching


def _fold(c: str) -> str:
    for a, b in scalar.SOUNDS:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


def _search_sql(q: str) -> str:
    m = int(len(q) * 0.35)
    typo = lambda ws, k: f"len(list_filter({ws}, lambda w: abs(length(w) - length({k})) <= {m + 1} AND levenshtein(w, {k}) <= {m})) > 0"
    return f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS t, string_split(lower(p_name), ' ') AS ws, {_fold('lower(p_name)')} AS pt, {_fold(f"'{q}'")} AS pq FROM part),
s AS (SELECT id, name, CAST(CASE WHEN t = '{q}' THEN 100 WHEN starts_with(t, '{q}') THEN 90 WHEN len(list_filter(ws, lambda w: starts_with(w, '{q}'))) > 0 THEN 82 WHEN contains(t, '{q}') THEN 75 WHEN contains(pt, pq) THEN 60
 WHEN len(list_filter(string_split(pt, ' '), lambda w: starts_with(w, pq))) > 0 THEN 55 WHEN {typo('ws', f"'{q}'")} THEN 45 WHEN {typo("string_split(pt, ' ')", 'pq')} THEN 40 ELSE 0 END AS DOUBLE) AS score FROM p)
SELECT id, name, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50"""


#: One query for each tier: equal, beginning, a word's beginning, inside, by sound, few typing errors.
ASKED = ("blue anvil", "blue", "gear", "lue gi", "gheer", "wudget", "blew")


@bound(" UNION ALL ".join(f"SELECT '{q}' AS query, * FROM ({_search_sql(q)})" for q in ASKED))
def search_scored(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.ranked_searches(p, list(ASKED), {"name": 1.0}, "id", k=50, collapse=False).select("query", "id", "name", "score")


@bound(f"""WITH q AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS query FROM part UNION SELECT DISTINCT left(string_split(p_name, ' ')[2], 3) || 'x' FROM part),
p AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS t, string_split(lower(p_name), ' ') AS ws, {_fold('lower(p_name)')} AS pt FROM part),
n AS (SELECT DISTINCT t, ws, pt FROM p), a AS (SELECT query, {_fold('lower(query)')} AS pq, CAST(floor(length(query) * 0.35) AS INT) AS m FROM q),
s AS (SELECT query, t, CAST(CASE WHEN t = query THEN 100 WHEN starts_with(t, query) THEN 90 WHEN len(list_filter(ws, lambda w: starts_with(w, query))) > 0 THEN 82 WHEN contains(t, query) THEN 75 WHEN contains(pt, pq) THEN 60
 WHEN len(list_filter(string_split(pt, ' '), lambda w: starts_with(w, pq))) > 0 THEN 55 WHEN len(list_filter(ws, lambda w: abs(length(w) - length(query)) <= m + 1 AND levenshtein(w, query) <= m)) > 0 THEN 45
 WHEN len(list_filter(string_split(pt, ' '), lambda w: abs(length(w) - length(pq)) <= m + 1 AND levenshtein(w, pq) <= m)) > 0 THEN 40 ELSE 0 END AS DOUBLE) AS score FROM n, a)
SELECT query, id, name, score FROM (SELECT query, id, name, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM s JOIN p USING (t) WHERE score > 0) WHERE r <= 20""")
def search_indexed(spark, d):
    """A table of questions: every first word of a name, and every second word's beginning with a wrong letter after it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    word = lambda i: F.get(F.split("name", " "), F.lit(i))
    asked = p.select(word(0).alias("query")).union(p.select(F.concat(F.substring(word(1), 1, 3), F.lit("x"))))
    return search.indexed_searches(p, asked, "name", "id", k=20, collapse=False).select("query", "id", "name", "score")


@bound("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS g, string_split(upper(p_name), ' ') AS t FROM part), w AS (SELECT id AS wid, g, list_reverse(t) AS t, array_to_string(list_reverse(t), ' ') AS k FROM p WHERE id % 50 = 0),
m AS (SELECT wid, id, CASE WHEN k = upper(name) THEN 1 WHEN len(list_filter(w.t, lambda x: NOT list_contains(p.t, x))) = 0 THEN 2 END AS pass FROM w JOIN p USING (g))
SELECT wid, arg_min(id, (pass, id)) AS matched, CAST(min(pass) AS BIGINT) AS pass FROM m WHERE pass IS NOT NULL GROUP BY wid""")
def fuzzy_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("g"))
    w = p.where("id % 50 = 0").select(F.col("id").alias("wid"), "g", F.array_join(F.reverse(F.split("name", " ")), " ").alias("wanted"))
    return matching.token_match(w, p, "g", "wanted", "name", "id").select("wid", F.col("match.id").alias("matched"), "pass")


@bound("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS g, string_split(upper(p_name), ' ') AS t FROM part), w AS (SELECT id AS wid, g, list_reverse(t) AS t, array_to_string(list_reverse(t), ' ') AS k FROM p),
m AS (SELECT wid, id, CASE WHEN k = upper(name) THEN 1 WHEN len(list_filter(w.t, lambda x: NOT list_contains(p.t, x))) = 0 THEN 2 END AS pass FROM w JOIN p USING (g))
SELECT wid, arg_min(id, (pass, id)) AS matched, CAST(min(pass) AS BIGINT) AS pass FROM m WHERE pass IS NOT NULL GROUP BY wid""")
def fuzzy_match_all(spark, d):
    """fuzzy_match for every name; that one's SQL asks for one in fifty."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("g"))
    w = p.select(F.col("id").alias("wid"), "g", F.array_join(F.reverse(F.split("name", " ")), " ").alias("wanted"))
    return matching.token_match(w, p, "g", "wanted", "name", "id").select("wid", F.col("match.id").alias("matched"), "pass")


@bound("""SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN n_nationkey WHEN s_nationkey % 3 = 1 THEN s_nationkey ELSE s_nationkey END AS found FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def name_cascade(spark, d):
    n = table(spark, d, "nation").select(scalar.name_key("n_name").alias("key"), F.col("n_nationkey").alias("number"), F.col("n_nationkey").alias("found"))
    s = table(spark, d, "supplier").join(n.select(F.col("key").alias("nk"), "number"), F.col("s_nationkey") == F.col("number")).drop("number")
    alias = {f"nation{i}": f"nation{i}" for i in range(3)}
    rows = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("no"), F.when(F.col("s_nationkey") % 3 == 0, F.col("nk")).otherwise(F.lit("?")).alias("nk"))
    return live.cascade(rows, n, F.col("nk"), "no", alias, dim_id="found").select("id", "found")


SIZES = [(1, 10, "small"), (8, 30, "middle"), (31, 40, "large")]


@bound("""SELECT p_partkey AS id, CASE WHEN p_size = 50 THEN 'top' WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 8 AND 30 THEN 'middle' WHEN p_size BETWEEN 31 AND 40 THEN 'large' ELSE 'other' END AS label FROM part""")
def range_bucket_join(spark, d):
    return matching.first_range(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "p_size", SIZES, {50: "top"}).select("id", "label")


@bound("""SELECT p_partkey AS id, label FROM part JOIN (VALUES (1, 10, 'small'), (8, 30, 'middle'), (31, 40, 'large')) r(low, high, label) ON p_size BETWEEN low AND high""")
def range_join(spark, d):
    r = spark.createDataFrame(SIZES, "low int, high int, label string")
    return matching.range_join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "p_size", r, 8).select("id", "label")


@bound(f"""WITH {V_CAND} SELECT id, CASE WHEN id = 5 THEN 'FURNITURE' ELSE party END AS party, CASE WHEN id = 5 THEN 44 WHEN id = 7 THEN 33 ELSE age END AS age, CAST(CASE id WHEN 5 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS BIGINT) AS applied FROM cand""")
def override_patch(spark, d):
    o = spark.createDataFrame([(5, "party", "FURNITURE"), (5, "age", "44"), (7, "age", "33"), (7, "_why", "x"), (-1, "age", "1")], "id long, field string, value string")
    return people.patched(cand(spark, d).select("id", "party", "age"), o, ["party", "age"]).withColumnRenamed("_applied", "applied")


@bound("""SELECT CAST(g AS BIGINT) AS id FROM (SELECT unnest(generate_series(1, (SELECT max(l_orderkey) FROM lineitem) + 50)) AS g) WHERE g NOT IN (SELECT l_orderkey FROM lineitem)""")
def gap_ids(spark, d):
    return matching.gaps(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), "id")


@bound("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def missing_paths(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti").select(F.col("o_orderkey").alias("id"))


@bound("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Homes' ELSE c_mktsegment END AS party FROM customer""")
def party_canonical(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalar.canonical("c_mktsegment", {"AUTOMOBILE": "Cars", "BUILDING": "Homes"}, "upper").alias("party"))


@bound(f"""WITH {V_VOTES} SELECT ac, y AS yr, coalesce(CAST(sum(votes) AS BIGINT), 0) AS votes FROM (SELECT DISTINCT n_nationkey AS ac FROM nation) CROSS JOIN (SELECT unnest([1998, 1999, 2030]) AS y) LEFT JOIN votes v USING (ac) WHERE v.yr = y OR v.yr IS NULL OR TRUE GROUP BY ac, y HAVING FALSE
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(y AS BIGINT), coalesce((SELECT CAST(sum(votes) AS BIGINT) FROM votes v WHERE v.ac = n_nationkey AND v.yr = y), 0) FROM nation CROSS JOIN (SELECT unnest([1998, 1999, 2030]) AS y)""")
def year_spine(spark, d):
    v = votes(spark, d).groupBy("ac", "yr").agg(F.sum("votes").alias("votes"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ac"))
    return matching.on_spine(v, n, "yr", [1998, 1999, 2030]).select("ac", F.col("yr").cast("long").alias("yr"), F.coalesce("votes", F.lit(0)).alias("votes"))


# ---------------------------------------------------------------- live events


def events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("party"), "value", (F.col("event_type") == "purchase").alias("declared"), "props")


@bound("""SELECT key, event_id, party, value FROM (SELECT user_id AS key, event_id, event_type AS party, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_by_key(spark, d):
    return live.latest(events(spark, d), "key", "ts", "event_id").select("key", "event_id", "party", "value")


@bound("""WITH g AS (SELECT user_id AS key, ts, event_type = 'purchase' AS dec, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT key, min(ts) AS declared_at, count(*) AS seen FROM g WHERE dec GROUP BY key, gap""")
def first_declared_run(spark, d):
    return live.declared_runs(events(spark, d), "key", "ts", "declared", "event_id")


@bound("""WITH l AS (SELECT user_id AS key, event_type AS party, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT key, party, CASE WHEN party = 'purchase' THEN 'declared' ELSE 'leading' END AS state FROM l WHERE r = 1 AND key % 10 <> 0""")
def declared_vs_leading(spark, d):
    now = live.latest(events(spark, d), "key", "ts", "event_id").where("key % 10 <> 0")
    done = now.where("declared")
    open_ = now.join(done.select("key"), "key", "left_anti")
    return done.select("key", "party", F.lit("declared").alias("state")).union(open_.select("key", "party", F.lit("leading").alias("state")))


#: Keys whose contest is on hold, as the reference lists one.
ON_HOLD = [152]


@bound(f"""WITH l AS (SELECT user_id AS key, event_type AS party, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT key, party, CASE WHEN party = 'purchase' THEN 'declared' ELSE 'leading' END AS state FROM l WHERE r = 1 AND (party = 'purchase' OR key NOT IN ({", ".join(map(str, ON_HOLD))}))""")
def declared_vs_leading_all(spark, d):
    """declared_vs_leading for every key but those leading on hold; that one's SQL leaves out each key that ten divides."""
    now = live.latest(events(spark, d), "key", "ts", "event_id")
    on_hold = spark.createDataFrame([(k,) for k in ON_HOLD], "key long")
    return live.declared_and_leading(now, "key", "declared", on_hold).select("key", "party", "state")


@bound("""SELECT event_type AS party, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 148""")
def majority_crossing(spark, d):
    return live.nth_event(events(spark, d), "party", "ts", "event_id", 148).select("party", "ts", "event_id")


@bound("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_prop(spark, d):
    return events(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@bound("""SELECT event_type AS party, CAST(count(*) AS BIGINT) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1""")
def group_counts(spark, d):
    return events(spark, d).groupBy("party").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


# ---------------------------------------------------------------- texts and pages


@bound("""SELECT page_id, CAST(len(m) AS BIGINT) AS links, CAST(len(list_distinct(m)) AS BIGINT) AS distinct_links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages)""")
def links_extracted(spark, d):
    p = table(spark, d, "pages").select("page_id", web.all_of(F.col("html"), 'href="([^"]*)"').alias("m"))
    return p.select("page_id", F.size("m").cast("long").alias("links"), F.size(F.array_distinct("m")).cast("long").alias("distinct_links"))


@bound("""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS k, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages""")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.name_key("url").alias("k"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"))


@bound("""SELECT source, count(*) AS n, count(quality) AS labelled, CAST(floor(CASE WHEN count(*) > 0 THEN CAST(count(quality) AS DOUBLE) / count(*) * 100 ELSE 0 END + 0.5) AS BIGINT) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def partial_coverage(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled")).withColumn("pct", percent("labelled", "n"))


@bound("""SELECT o_orderkey AS id, CASE WHEN v >= 1e7 THEN CAST(CAST(floor(v / 1e7 * 100 + 0.5) / 100 AS DECIMAL(20, 2)) AS VARCHAR) || ' Cr' WHEN v >= 1e5 THEN CAST(CAST(floor(v / 1e5 * 100 + 0.5) / 100 AS DECIMAL(20, 2)) AS VARCHAR) || ' L'
 WHEN v >= 1e3 THEN CAST(CAST(floor(v / 1e3 * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR) || 'K' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) * (CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END) AS v FROM orders)""")
def amounts(spark, d):
    v = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(1)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalar.amount(v).alias("shown"))


@bound("""WITH RECURSIVE n AS (SELECT list_sort(list(n_nationkey)) AS a FROM nation), s(i, seed, a) AS (SELECT len(a) - 1, CAST(20000 AS BIGINT), a FROM n
UNION ALL SELECT i - 1, t, list_transform(range(len(a)), lambda k: CASE WHEN k = i THEN a[j + 1] WHEN k = j THEN a[i + 1] ELSE a[k + 1] END)
FROM (SELECT i, a, t, CAST(floor(t / 4294967296.0::DOUBLE * (i + 1)) AS BIGINT) AS j FROM (SELECT i, a, (seed * 1664525 + 1013904223) % 4294967296 AS t FROM s WHERE i >= 1)))
SELECT unnest(range(6)) AS place, unnest(a[1:6]) AS n_nationkey FROM s WHERE i = 0""")
def seeded_shuffle(spark, d):
    n = table(spark, d, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("a"))
    return n.select(F.posexplode(F.slice(scalar.shuffled(F.col("a"), F.lit(20000)), 1, 6)).alias("place", "n_nationkey"))


# ---------------------------------------------------------------- listings


def _numbered(df: DataFrame, order: list) -> DataFrame:
    return keys.numbered(df, order)


@bound(f"""WITH {V_VOTES}, {WON} SELECT ac, row_number() OVER (ORDER BY (ac % 3 = 0) DESC, CASE WHEN ac % 5 <> 0 THEN margin END DESC NULLS LAST, ac) AS place FROM won WHERE yr = {NOW}""")
def flag_first_order(spark, d):
    w = won(spark, d, NOW).select("ac", (F.col("ac") % 3 == 0).alias("flag"), F.when(F.col("ac") % 5 != 0, F.col("margin")).alias("value"))
    return _numbered(w, listing.flagged_first("flag", "value", "ac")).select("ac", "place")


@bound(f"""WITH {V_VOTES}, {WON} SELECT ac AS id, row_number() OVER (ORDER BY CASE WHEN ac % 2 = 0 THEN ac % 7 END DESC NULLS LAST, margin DESC, ac) AS place FROM won WHERE yr = {NOW}""")
def declared_order(spark, d):
    w = won(spark, d, NOW).select(F.col("ac").alias("id"), "margin", F.when(F.col("ac") % 2 == 0, F.col("ac") % 7).alias("declared_at"))
    return _numbered(w, listing.newest_declared()).select("id", "place")


@bound(f"""WITH {V_CAND}, e AS (SELECT education, count(*) AS n FROM cand GROUP BY 1)
SELECT education, n, row_number() OVER (ORDER BY CASE education WHEN 'Literate' THEN 1 WHEN '12th Pass' THEN 2 ELSE 3 END, education) AS place FROM e""")
def listed_order(spark, d):
    e = cand(spark, d).groupBy("education").agg(F.count("*").alias("n"))
    return _numbered(e, listing.in_listed_order("education", ["Literate", "12th Pass"]))


@bound(f"""WITH {V_DEMO} (SELECT 'top' AS "end", ac, people FROM demo ORDER BY people DESC, ac LIMIT 5) UNION ALL (SELECT 'bottom', ac, people FROM demo ORDER BY people, ac DESC LIMIT 5)""")
def top_and_bottom(spark, d):
    return listing.ends(_demo(spark, d).select("ac", "people"), "people", "ac")


@bound(f"""WITH {V_CAND} SELECT count(*) FILTER (ac IN (1, 2, 3, 4)) AS inside, count(*) FILTER (ac NOT IN (1, 2, 3, 4)) AS outside FROM cand""")
def phase_split(spark, d):
    return listing.split_counts(cand(spark, d), "ac", [1, 2, 3, 4])


@bound(f"""WITH {V_CAND} SELECT id, assets - liabilities AS net, CASE WHEN assets < liabilities THEN 'negative' WHEN assets > liabilities THEN 'positive' ELSE 'none' END AS sign, abs(assets - liabilities) AS size FROM cand""")
def net_assets(spark, d):
    return cand(spark, d).select("id", listing.net_worth(F.col("assets"), F.col("liabilities")).alias("x")).select("id", "x.*")


@bound("""SELECT p_brand AS g, min(p_size) - 35.0 AS "left", min(p_retailprice) - 35.0 AS top, max(p_size) + 35.0 AS "right", max(p_retailprice) + 35.0 AS bottom FROM part GROUP BY 1""")
def bounding_box(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return listing.frame(p, ["g"])


@bound(f"""WITH {V_VOTES} SELECT party, floor(CAST(sum(votes) AS DOUBLE) / (SELECT CAST(sum(votes) AS DOUBLE) FROM votes WHERE yr = {NOW}) * 100 * 100 + 0.5) / 100 AS share FROM votes WHERE yr = {NOW} GROUP BY party ORDER BY share DESC, party LIMIT 1""")
def top_vote_share(spark, d):
    return listing.top_share(votes(spark, d, NOW).groupBy("party").agg(F.sum("votes").alias("votes"))).withColumn("share", half_up("share", 2))


@bound("""SELECT n_regionkey AS region, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def joined_ids(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey")
    return listing.joined_text(n, ["region"], "n_nationkey", "n_nationkey")


@bound(f"""WITH {V_CAND}, m AS (SELECT min(cases) AS c, min(liabilities) AS l FROM cand WHERE id IN (4, 8, 15, 16, 23, 42)) SELECT id, cases = c AS best_cases, liabilities = l AS best_liabilities FROM cand, m WHERE id IN (4, 8, 15, 16, 23, 42)""")
def compared(spark, d):
    chosen = people.by_ids(cand(spark, d).select("id", "cases", "liabilities"), [4, 8, 15, 16, 23, 42])
    return people.best_in_set(chosen, ["cases", "liabilities"]).select("id", "best_cases", "best_liabilities")


@bound(f"""WITH {V_CAND} SELECT party, count(*) AS n, count(*) FILTER (cases > 0) AS with_cases, floor(CAST(count(*) FILTER (cases > 0) AS DOUBLE) / count(*) * 100 * 100 + 0.5) / 100 AS case_rate,
 CAST(floor(coalesce(avg(CAST(assets AS DOUBLE)) FILTER (assets > 0), 0) + 0.5) AS BIGINT) AS avg_assets, CASE party WHEN 'BUILDING' THEN 120.5 WHEN 'MACHINERY' THEN 80.0 ELSE 0 END AS funds FROM cand WHERE party IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY party""")
def party_profile(spark, d):
    funds = spark.createDataFrame([("BUILDING", 120.5), ("MACHINERY", 80.0)], "party string, funds double")
    return people.party_profile(cand(spark, d), funds, MAJORS).withColumn("case_rate", half_up("case_rate", 2)).withColumn("avg_assets", half_up("avg_assets"))


# The rest of the operators, bound one by one.
from tallyforge import column_bindings, live_bindings, source_bindings  # noqa: E402, F401
