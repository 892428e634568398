"""Column functions and small operators bound to the harness tables, one query each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.bindings import MAJORS, ORACLE_SQL, QUERIES, V_CAND, V_JOB, _fold, _numbered, bound, cand, job, table
from tallyforge.functions import scalar
from tallyforge.operators import listing, live, matching, people, quiz, search


def column(name: str, source: str, key: str, value: Callable[[], Column], sql: str) -> None:
    """Registers a query of a table's key and one computed column v."""
    QUERIES[name] = lambda spark, d: table(spark, d, source).select(F.col(key).alias("id"), value().alias("v"))
    ORACLE_SQL[name] = f"SELECT {key} AS id, {sql} AS v FROM {source}"


NOW = "2024-01-20 00:00:00"


def part(name: str, value: Callable[[], Column], sql: str) -> None:
    column(name, "part", "p_partkey", value, sql)


def event(name: str, value: Callable[[], Column], sql: str) -> None:
    column(name, "events", "event_id", value, sql)


_SLUGGED = "p_name || '  ' || p_type || ' (' || p_brand || ')'"
part("slugs", lambda: scalar.slug(F.concat(F.col("p_name"), F.lit("  "), F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")"))), rf"regexp_replace(regexp_replace(lower({_SLUGGED}), '\s+', '-', 'g'), '[^\w-]', '', 'g')")
part("person_keys", lambda: scalar.person_key(F.concat(F.lit("Dr. "), F.col("p_name"), F.lit("  -"), F.col("p_brand"))), "trim(regexp_replace(regexp_replace(upper('Dr. ' || p_name || '  -' || p_brand), '[^A-Z ]', '', 'g'), ' +', ' ', 'g'))")
part("place_keys", lambda: scalar.place_key(F.concat(F.col("p_name"), F.lit(" (SC) ")), {"anvil": "forge"}), r"replace(regexp_replace(lower(p_name), '\banvil\b', 'forge', 'g'), ' ', '')")
part("same_names", lambda: scalar.same_name(F.upper(F.col("p_name")), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("."))), "p_partkey % 3 <> 0")
part("sound_keys", lambda: scalar.sound_key(F.col("p_name"), False), _fold("lower(p_name)"))
part("title_cases", lambda: scalar.title_case(F.concat(F.upper(F.col("p_name")), F.lit("-x"))), "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-X'")
part("stripped_markup", lambda: scalar.strip_markup(F.concat(F.lit(" <b class='x'>"), F.col("p_name"), F.lit("</b>&nbsp; <i>"), F.col("p_type"), F.lit("</i>&amp;x"))), "p_name || ' ' || p_type || ' x'")
part("cell_texts", lambda: scalar.cell_text(F.concat(F.lit("<td>"), F.col("p_name"), F.lit("<br>"), F.col("p_type"), F.lit("&nbsp;</td>"))), "p_name || ' ' || p_type")
part("rupees", lambda: scalar.money(F.concat(F.lit("Rs. "), F.format_number(F.col("p_size") * 123456, 0), F.lit(" ~"))), "CAST(p_size AS BIGINT) * 123456")
part("rupee_units", lambda: scalar.money_units(F.concat(F.lit("Rs "), F.col("p_size").cast("string"), F.lit(".5"), F.when(F.col("p_partkey") % 2 == 0, " Crore").otherwise(" Lakh"))), "CAST((p_size * 10 + 5) * CASE WHEN p_partkey % 2 = 0 THEN 1000000 ELSE 10000 END AS BIGINT)")
part("decimals", lambda: scalar.decimal_value(F.concat(F.lit("up "), (-F.col("p_size")).cast("string"), F.lit(".25 %"))), "-(p_size + 0.25)::DOUBLE")
part("plain_digits", lambda: scalar.digits_value(F.concat(F.col("p_brand"), F.lit(" no "), F.col("p_size").cast("string"))), "CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') || p_size AS BIGINT)")
part("reserved_seats", lambda: scalar.reservation(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " (SC)").when(F.col("p_partkey") % 3 == 1, " (st)").otherwise(" (GEN)"))), "CASE p_partkey % 3 WHEN 0 THEN 'SC' WHEN 1 THEN 'ST' ELSE 'General' END")
part("listed_classes", lambda: scalar.listed_class(F.col("p_name"), {r"\brod\b": "title"}, {"first": ["blue", "cold"]}), "CASE WHEN p_name LIKE '% rod' THEN 'title' WHEN split_part(p_name, ' ', 1) IN ('blue', 'cold') THEN 'first' END")
part("section_lists", lambda: F.array_join(scalar.split_list(F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(" /;"), F.col("p_size").cast("string"))), "|"), "p_brand || '|' || p_type || '|' || p_size")
part("padded_ids", lambda: scalar.padded_id(F.col("p_partkey")), "'c' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE CAST(p_partkey AS VARCHAR) END")
part("news_texts", lambda: scalar.query_text(F.col("p_name"), F.col("p_brand"), "election"), "'\"' || p_name || '\" ' || p_brand || ' election'")
part("circle_points", lambda: F.array_join(F.transform(F.array(scalar.on_circle(F.col("p_size") * 7.25, 100.0)["x"], scalar.on_circle(F.col("p_size") * 7.25, 100.0)["y"]), lambda v: F.floor(v * 1000 + 0.5).cast("string")), ","), "CAST(floor(100 * cos(radians(p_size * 7.25)) * 1000 + 0.5) AS BIGINT) || ',' || CAST(floor(100 * sin(radians(p_size * 7.25)) * 1000 + 0.5) AS BIGINT)")
part("tones", lambda: scalar.tone((255, 0, 10), (0, 128, 255), F.col("p_size") / 64.0), "'rgb(' || CAST(floor(255 - 255 * (p_size / 64.0::DOUBLE) + 0.5) AS BIGINT) || ',' || CAST(floor(128 * (p_size / 64.0::DOUBLE) + 0.5) AS BIGINT) || ',' || CAST(floor(10 + 245 * (p_size / 64.0::DOUBLE) + 0.5) AS BIGINT) || ')'")
part("levels", lambda: scalar.level(F.col("p_size"), [(40, "high"), (20, "middle")], "low"), "CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'middle' ELSE 'low' END")
part("csv_fields", lambda: scalar.csv_field(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit(', "x"'))).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))), "CASE p_partkey % 3 WHEN 0 THEN '\"' || p_name || ', \"\"x\"\"\"' WHEN 1 THEN p_name ELSE '' END")
part("dashes", lambda: scalar.blank_as_dash(F.col("p_partkey") % 4, F.concat(F.lit("n"), (F.col("p_partkey") % 4).cast("string"))), "CASE WHEN p_partkey % 4 = 0 THEN '—' ELSE 'n' || p_partkey % 4 END")
part("stance_percents", lambda: quiz.stance_percent(F.col("p_partkey") % 5 - 2), "CAST(p_partkey % 5 AS DOUBLE) * 25")
part("replaced_entries", lambda: F.array_join(F.transform(scalar.replaced(F.array(F.struct(F.lit("a").alias("k"), F.lit(1).alias("v")), F.struct(F.lit("b").alias("k"), F.lit(2).alias("v"))), "k", F.struct(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("c").alias("k"), F.col("p_size").alias("v"))), lambda x: F.concat(x["k"], x["v"].cast("string"))), ","), "CASE WHEN p_partkey % 2 = 0 THEN 'b2,a' || p_size ELSE 'a1,b2,c' || p_size END")
part("words_inside", lambda: matching.any_token_inside("p_name", "p_type"), "contains(lower(p_type), split_part(lower(p_name), ' ', 1)) OR contains(lower(p_type), split_part(lower(p_name), ' ', 2))")

_LEFT = f"greatest(0, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT))"


def _at() -> Column:
    return F.col("ts").cast("timestamp")


def _then(text: str = NOW) -> Column:
    return F.to_timestamp(F.lit(text))


event("countdowns", lambda: F.concat_ws(":", *[scalar.remaining(_then(), _at())[p].cast("long").cast("string") for p in ("days", "hours", "minutes", "seconds")]), f"({_LEFT} // 86400) || ':' || ({_LEFT} % 86400 // 3600) || ':' || ({_LEFT} % 3600 // 60) || ':' || ({_LEFT} % 60)")
event("age_texts", lambda: scalar.age_text(_at(), _then("2024-02-20 00:00:00")), "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END".replace("s ", "(CAST(epoch(TIMESTAMP '2024-02-20 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) "))
event("fresh_or_not", lambda: scalar.is_fresh(_at(), _then(), 60 * 24), f"CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) < 86400")
event("day_indexes", lambda: scalar.day_index(_at()).cast("long"), "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))")


# ---------------------------------------------------------------- people


@bound(f"""WITH {V_CAND}, f AS (SELECT ac, (age > 0)::INT + (gender IS NOT NULL)::INT + (education <> 'Not declared')::INT + (assets <> 0)::INT + (url <> '')::INT + ({V_JOB} = 'Farmer')::INT AS n FROM cand)
SELECT ac, CAST(floor(CAST(sum(n) AS DOUBLE) / (count(*) * 6) * 100 + 0.5) AS BIGINT) AS quality FROM f GROUP BY ac""")
def quality_of_six(spark, d):
    return people.quality_of_six(cand(spark, d).withColumn("occupation", job()), ["ac"])


@bound(f"""WITH {V_CAND} SELECT DISTINCT gender FROM cand WHERE gender IS NOT NULL""")
def distinct_genders(spark, d):
    return people.distinct_values(cand(spark, d), "gender")


@bound(f"""WITH {V_CAND} SELECT id, name FROM cand WHERE party = 'BUILDING' AND gender = 'Female'""")
def optional_filters(spark, d):
    return people.equal_to(cand(spark, d), party="BUILDING", gender="Female", education="").select("id", "name")


@bound(f"""WITH {V_CAND}, w AS (SELECT unnest([42, 7, 16]) AS id, unnest([1, 2, 3]) AS place) SELECT CAST(place AS BIGINT) AS place, id, name FROM cand JOIN w USING (id)""")
def ordered_lookup(spark, d):
    ids = [42, 7, -5, 16]
    found = people.by_ids(cand(spark, d), ids)
    return found.select(F.array_position(F.array(*[F.lit(i).cast("long") for i in ids if i > 0]), F.col("id")).alias("place"), "id", "name")


@bound(f"""WITH {V_CAND} SELECT ac, count(*) AS n FROM cand WHERE id NOT IN (1, 2, 3) GROUP BY ac""")
def still_choosable(spark, d):
    return people.not_chosen(cand(spark, d), [1, 2, 3]).groupBy("ac").agg(F.count("*").alias("n"))


@bound(f"""WITH {V_CAND} SELECT id FROM cand WHERE assets = 0 AND liabilities = 0 AND url <> '' OR id % 50 = 1 AND url <> ''""")
def without_financials(spark, d):
    none = F.col("id") % 50 == 1
    c = cand(spark, d).withColumns({"assets": F.when(none, 0).otherwise(F.col("assets")), "liabilities": F.when(none, 0).otherwise(F.col("liabilities"))})
    return people.missing_financials(c).select("id")


@bound(f"""WITH {V_CAND} SELECT id FROM cand WHERE {V_JOB} <> 'Farmer'""")
def without_occupation(spark, d):
    return people.missing_occupation(cand(spark, d).withColumn("occupation", job())).select("id")


@bound(f"""WITH {V_CAND} SELECT id FROM cand WHERE id % 2 = 0""")
def active_rows(spark, d):
    return people.secured(cand(spark, d).withColumn("is_active", F.col("id") % 2 == 0)).select("id")


@bound(f"""WITH {V_CAND} SELECT c.id, coalesce(p.name, 'Independent') AS party_name, coalesce(p.color, '#546E7A') AS color, n.n_name AS contest_name FROM cand c LEFT JOIN (VALUES ('BUILDING', 'Builders', '#112233')) p(id, name, color) ON c.party = p.id LEFT JOIN nation n ON c.ac = n.n_nationkey AND n.n_nationkey < 20""")
def denormalised_people(spark, d):
    parties = spark.createDataFrame([("BUILDING", "Builders", "#112233")], "id string, name string, color string")
    contests = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    out = people.denormalised(cand(spark, d).withColumn("contest", F.col("ac")), parties, contests, people.NO_PARTY)
    return out.select("id", F.col("party_info.name").alias("party_name"), F.col("party_info.color").alias("color"), F.col("contest_info.name").alias("contest_name"))


# ---------------------------------------------------------------- quiz

_WEIGHTS = [(1, "a", "BUILDING", 8), (1, "a", "MACHINERY", 2), (1, "b", "FURNITURE", 7), (2, "a", "BUILDING", 3), (2, "b", "AUTOMOBILE", 9)]
V_ALIGN = f"""w AS (SELECT * FROM (VALUES {", ".join(map(str, _WEIGHTS))}) t(question, option, party, weight)),
a AS (SELECT id AS session, id // 50 AS ac, q AS question, CASE WHEN (id + q) % 2 = 0 THEN 'a' ELSE 'b' END AS option FROM cand, (SELECT unnest([1, 2, 3]) AS q)),
scores AS (SELECT session, ac, party, CAST(floor(CAST(sum(weight) AS DOUBLE) / 30 * 100 + 0.5) AS BIGINT) AS score FROM a JOIN w USING (question, option) GROUP BY ALL)"""


def _fifties(spark, d):
    return cand(spark, d).withColumn("ac", F.floor(F.col("id") / 50))


def _scores(spark, d):
    """Every contestant answers three questions, of which the quiz knows two; a contest is fifty keys."""
    weights = spark.createDataFrame(_WEIGHTS, "question int, option string, party string, weight int")
    own = _fifties(spark, d)
    answers = own.select(F.col("id").alias("session"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("question"))
    found = quiz.alignment(answers.withColumn("option", F.when((F.col("session") + F.col("question")) % 2 == 0, "a").otherwise("b")), weights)
    return found.join(own.select(F.col("id").alias("session"), "ac"), "session")


@bound(f"""WITH {V_CAND}, {V_ALIGN} SELECT session, arg_min(party, (-score, party)) AS party, max(score) AS score FROM scores GROUP BY session""")
def quiz_top_pick(spark, d):
    return quiz.top_pick(_scores(spark, d))


@bound(f"""WITH {V_CAND}, {V_ALIGN}, asked AS (SELECT DISTINCT session, ac FROM scores),
f AS (SELECT a.session, t.id, CAST(floor(coalesce(s.score, 0) * 0.6::DOUBLE + t.integrity * 0.4::DOUBLE + 0.5) AS BIGINT) AS final FROM asked a JOIN tiered t ON a.ac = t.id // 50 LEFT JOIN scores s ON s.session = a.session AND s.party = t.party)
SELECT session, id, final, row_number() OVER (PARTITION BY session ORDER BY final DESC, id) AS place FROM f""")
def quiz_rank(spark, d):
    return quiz.ranked_people(_fifties(spark, d), _scores(spark, d), "ac").select("session", "id", "final", "place")


# ---------------------------------------------------------------- listings, matching, live


@bound(f"""WITH {V_CAND}, e AS (SELECT education, count(*) AS n FROM cand GROUP BY 1) SELECT education, row_number() OVER (ORDER BY CASE education WHEN 'PhD in History' THEN 4 WHEN 'Post Graduate' THEN 3 WHEN 'Literate' THEN 1 ELSE 0 END DESC, education) AS place FROM e""")
def order_by_rank_map(spark, d):
    e = cand(spark, d).groupBy("education").agg(F.count("*").alias("n"))
    return _numbered(e, listing.by_rank_of("education", {"PhD in History": 4, "Post Graduate": 3, "Literate": 1}, "education")).select("education", "place")


@bound(f"""WITH {V_CAND} SELECT avg(age) AS mean, count(*) AS n FROM cand WHERE age > 0""")
def mean_of_present(spark, d):
    return listing.mean_present(cand(spark, d), "age")


@bound("""SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'blue') OR contains(p_type, 'blUE')) AND p_brand = 'Brand#2'""")
def names_that_hold(spark, d):
    return search.contains_either(table(spark, d, "part"), "blUE", "p_name", "p_type", p_brand="Brand#2", p_type="").select(F.col("p_partkey").alias("id"))


@bound("""(SELECT 'place' AS kind, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'an') ORDER BY n_nationkey LIMIT 4) UNION ALL
(SELECT 'person', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_partkey LIMIT 6)""")
def mixed_search(spark, d):
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return search.mixed_hits(places, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), " AN ")


@bound("""WITH x AS (SELECT a.p_name AS short, b.p_name AS long FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON split_part(a.p_name, ' ', 1) <> split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name)
SELECT short, long FROM x WHERE split_part(short, ' ', 2) = split_part(long, ' ', 2)""")
def part_of_name_match(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    words = lambda side: names.select(F.col("p_name").alias(side), F.explode(F.split("p_name", " ")).alias("w"))
    return words("short").join(words("long"), "w").where("short < long").where(matching.any_token_inside("short", "long")).where("split_part(short, ' ', 1) <> split_part(long, ' ', 1)").select("short", "long")


@bound(f"""WITH {V_CAND}, n AS (SELECT party, count(*) AS total, count(*) FILTER (id % 3 = 0) AS won FROM cand GROUP BY party), b AS (SELECT * FROM (VALUES ('BUILDING', 40), ('GONE', 3)) t(party, seats_prev))
SELECT party, coalesce(won, 0) AS won, greatest(0, coalesce(total, 0) - coalesce(won, 0)) AS leading, coalesce(total, 0) - coalesce(seats_prev, 0) AS delta FROM n FULL JOIN b USING (party)""")
def won_and_leading(spark, d):
    before = spark.createDataFrame([("BUILDING", 40), ("GONE", 3)], "party string, seats_prev long")
    return live.won_and_leading(cand(spark, d).select("party", (F.col("id") % 3 == 0).alias("declared")), before)
