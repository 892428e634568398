"""Contestants: statistics per contest and party, facts, picks, facets, pages, patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.profile import UNKNOWN, asset_bucket, declared, education_tier, filled_share
from tallyforge.functions.scalar import amount, half_up, percent, ratio
from tallyforge.operators.keys import medians, running

SIX = ("age", "gender", "education", "assets", "url", "occupation")
FIVE = ("age", "education", "assets", "url", "gender")
#: What a page shows for a party that isn't known.
NO_PARTY = {"id": "IND", "name": "Independent", "color": "#546E7A"}
GENDERS, EDUCATIONS, BUCKETS = ("Male", "Female", "Other"), ("None", "School", "Graduate", "Post Graduate", "Doctorate"), ("Low", "Medium", "High", "Very High")


def education_name(education: Column) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in EDUCATIONS]), education_tier(education) + 1)


def mean_positive(x: str) -> Column:
    """Aggregate: mean of the values over 0; 0 if there is none."""
    return F.coalesce(F.avg(F.when(F.col(x) > 0, F.col(x))), F.lit(0.0))


def insights(people: DataFrame, group: list[str]) -> DataFrame:
    """Per group: counts, mean and median assets, genders, data quality; all but the median from one aggregation."""
    out = people.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("cases") > 0).alias("with_cases"),
        F.count_if(F.col("gender") == "Female").alias("women"),
        F.count_if("incumbent").alias("incumbents"),
        F.avg(F.col("assets").cast("double")).alias("avg_assets"),
        mean_positive("age").alias("avg_age"),
        # Whatever isn't one of the others counts as the first of the list.
        F.count_if(~F.coalesce(F.col("gender").isin(*GENDERS[1:]), F.lit(False))).alias("men"),
        F.count_if(F.col("gender") == "Other").alias("others"),
        filled_share([F.col(c) for c in SIX]).alias("quality"),
    )
    return with_median(out, people, group, "assets").withColumn("median", F.coalesce("median", F.lit(0.0))).withColumnRenamed("median", "median_assets")


def with_median(groups: DataFrame, rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """groups (one row each) with the exact median of their rows' values; null where none has one."""
    m = medians(rows, group, value).withColumnsRenamed({c: f"_{c}" for c in group})
    same = reduce(lambda x, y: x & y, (groups[c].eqNullSafe(m[f"_{c}"]) for c in group))
    return groups.join(m, same, "left").drop(*[f"_{c}" for c in group])


def mean_of_rates(groups: DataFrame, count: str, hit: str) -> DataFrame:
    """Mean over groups with members of their rates."""
    own = groups.agg(F.sum(ratio(hit, count)).alias("s"), F.count_if(F.col(count) > 0).alias("k"))
    return own.select(ratio("s", "k").alias("mean_rate"))


def histogram(people: DataFrame, value: Column, names: tuple[str, ...], group: list[str]) -> DataFrame:
    """Counts per group and name of a fixed list, zeros included, from one conditional aggregation."""
    wide = people.withColumn("_v", value).groupBy(*group).agg(*[F.count_if(F.col("_v") == n).alias(n) for n in names])
    return wide.select(*group, F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select(*group, "x.bucket", "x.n")


def asset_histogram(people: DataFrame, group: list[str]) -> DataFrame:
    return histogram(people, asset_bucket(F.col("assets")), BUCKETS, group)


def education_histogram(people: DataFrame, group: list[str]) -> DataFrame:
    return histogram(people, education_name(F.col("education")), EDUCATIONS, group)


def party_profile(people: DataFrame, funding: DataFrame, parties: list[str]) -> DataFrame:
    """Per listed party: people, case rate, mean assets and funds."""
    own = people.where(F.col("party").isin(parties)).groupBy("party").agg(F.count("*").alias("n"), F.count_if(F.col("cases") > 0).alias("with_cases"), mean_positive("assets").alias("avg_assets"))
    return own.join(funding, "party", "left").withColumn("case_rate", ratio("with_cases", "n", 100.0)).na.fill(0)


def funding_shares(funding: DataFrame, value: str) -> DataFrame:
    """Shares of the largest and of all, and where each slice of a ring starts (degrees, from -90)."""
    every = funding.agg(F.max(value).alias("_max"), F.sum(value).alias("_total"))
    rows = running(funding, [F.desc_nulls_last(value), F.asc("party")], value, "_before_it").join(F.broadcast(every))
    return rows.select(*funding.columns, ratio(F.col(value), F.col("_max")).alias("of_max"), half_up(ratio(F.col(value), F.col("_total"), 100.0), 1).alias("pct"), (ratio(F.col("_before_it"), F.col("_total"), 360.0) - 90).alias("start"))


def hot_seats(people: DataFrame, group: str, majors: list[str]) -> DataFrame:
    """Contested seats by 0.3 per contestant and 15 per major party present."""
    major = F.count_distinct(F.when(F.col("party").isin(majors), F.col("party")))
    return people.groupBy(group).agg(F.count("*").alias("n"), major.alias("majors"), F.count_if(F.col("cases") > 0).alias("criminal")).withColumn("score", F.col("n") * 0.3 + F.col("majors") * 15)


def facts(people: DataFrame, group: str) -> DataFrame:
    """Facts per group as rows (kind, who, value), each only where it says something."""
    first = lambda order, cond=None: F.min_by(F.when(cond, F.col("name")) if cond is not None else F.col("name"), F.when(cond, order) if cond is not None else order)
    p = people.withColumn("_tier", education_tier(F.col("education")))
    aged = F.col("age") > 0
    g = p.groupBy(group).agg(
        F.count("*").alias("n"),
        first(F.struct(-F.col("assets"), "id")).alias("richest"),
        F.max("assets").alias("most"),
        F.avg(F.col("assets").cast("double")).alias("mean"),
        first(F.struct(-F.col("cases"), "id")).alias("accused"),
        F.max("cases").alias("cases"),
        F.count_if(F.col("cases") == 0).alias("clean"),
        first(F.struct("age", "id"), aged).alias("youngest"),
        F.min(F.when(aged, F.col("age"))).alias("low"),
        first(F.struct(-F.col("age"), "id"), aged).alias("oldest"),
        F.max(F.when(aged, F.col("age"))).alias("high"),
        F.count_if(F.col("gender") == "Female").alias("women"),
        first(F.struct(-F.col("_tier"), "id")).alias("scholar"),
        F.max("_tier").alias("tier"),
        F.count_if("incumbent").alias("sitting"),
        F.count_distinct("party").alias("parties"),
    )
    g = with_median(g, people, [group], "assets")
    spread = half_up(ratio("mean", "median"), 1)
    none = F.lit(None).cast("string")
    kinds = [
        ("wealthiest", F.col("most") > 0, F.col("richest"), F.col("most")),
        ("most-cases", F.col("cases") > 0, F.col("accused"), F.col("cases")),
        ("clean-record", F.lit(True), none, percent("clean", "n")),
        ("youngest", F.col("low").isNotNull(), F.col("youngest"), F.col("low")),
        ("oldest", F.col("high") != F.col("low"), F.col("oldest"), F.col("high")),
        ("women", F.col("women") > 0, none, percent("women", "n")),
        ("most-educated", F.col("tier") >= 3, F.col("scholar"), F.col("tier")),
        ("incumbents", F.col("sitting") > 0, none, F.col("sitting")),
        ("asset-spread", (F.col("median") > 0) & (spread > 1.5), none, spread),
        ("party-count", F.lit(True), none, F.col("parties")),
    ]
    rows = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(k).alias("kind"), who.alias("who"), value.cast("double").alias("value"))) for k, cond, who, value in kinds]
    return g.select(group, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(group, "x.*")


def fact_text(kind: Column, who: Column, value: Column) -> Column:
    return F.when(kind == "wealthiest", F.concat(F.lit("Wealthiest: "), who, F.lit(" ("), amount(value), F.lit(")"))).when(kind.isin("clean-record", "women"), F.concat(half_up(value).cast("string"), F.lit("%"))).otherwise(F.concat_ws(" ", who, value.cast("string")))


def faces(people: DataFrame, group: str, majors: list[str], k: int = 5) -> DataFrame:
    """Picks per group without repeats, with the reason of each: 1 every incumbent, 2 the richest, 3 most cases, 4 the
    first of each major party in the list's order, 5 others by id. 4 and 5 fill up to k.

    Each step takes from those that no step before it has taken.
    """

    def first(own: Column, *order: Column, within: tuple[str, ...] = ()) -> Column:
        return own & (F.row_number().over(Window.partitionBy(group, *within, own).orderBy(*order, "id")) == 1)

    reason = lambda at, cond: F.when(F.col("reason") > 0, F.col("reason")).when(cond, at).otherwise(0)
    free = F.col("reason") == 0
    p = people.withColumn("reason", F.when(F.coalesce("incumbent", F.lit(False)), 1).otherwise(0))
    p = p.withColumn("reason", reason(2, first(free & (F.col("assets") > 0), F.desc("assets"))))
    p = p.withColumn("reason", reason(3, first(free & (F.col("cases") > 0), F.desc("cases"))))
    p = p.withColumn("reason", reason(4, first(free & F.col("party").isin(majors), within=("party",))))
    listed = F.array_position(F.array(*[F.lit(m) for m in majors]), F.col("party"))
    p = p.withColumn("reason", F.when(free, 5).otherwise(F.col("reason")).cast("long"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("reason", F.when(F.col("reason") == 4, listed), "id"))
    return p.withColumn("_place", place).where((F.col("reason") <= 3) | (F.col("_place") <= k)).drop("_place")


def facets(people: DataFrame, text: str = "", party: str = "", district: str = "", cases_only: bool = False) -> DataFrame:
    """People by optional facets; a text counts from two characters on, in the name or the packed place."""
    q = text.strip().lower()
    tests = []
    if len(q) >= 2:
        tests.append(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("place"), F.lit(q)))
    if party:
        tests.append(F.col("party") == party)
    if district:
        tests.append(F.element_at(F.split("place", "[|]"), 2) == district)
    if cases_only:
        tests.append(F.col("cases") > 0)
    return people.where(reduce(lambda a, b: a & b, tests)) if tests else people


def sorted_by(people: DataFrame, how: str) -> list[Column]:
    """Order of a listing: name in the language's order, or assets, cases or age up or down."""
    field, _, way = how.partition("-")
    if field == "name":
        return [F.expr("collate(name, 'UNICODE')").asc(), F.asc("id")]
    return [F.asc(field) if way == "asc" else F.desc(field), F.asc("id")]


def equal_to(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns equal the values given; an empty value asks for nothing."""
    tests = [F.col(c) == v for c, v in wanted.items() if v]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def by_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of the given ids in their order; unknown ids are dropped."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), key).orderBy("pos").drop("pos")


def not_chosen(df: DataFrame, ids: list, key: str = "id", most: int = 6) -> DataFrame:
    """Rows that can still be chosen: none once `most` are."""
    return df.where(~F.col(key).isin(ids)) if 0 < len(ids) < most else df.limit(0) if len(ids) >= most else df


def patched(df: DataFrame, changes: DataFrame, fields: list[str], key: str = "id", order: str | None = None) -> DataFrame:
    """df with the fields of changes (key, field, value) applied; names that start with _ and unknown ids are ignored.

    `_applied` counts the changes of a row. Of several changes to one field the last by the column `order` counts, and
    of those without an order, or with the same, the largest value as a text.
    """
    last = F.max_by("value", F.struct(F.col(order), F.col("value")) if order else F.col("value"))
    own = changes.where(~F.startswith("field", F.lit("_")) & F.col("field").isin(fields)).groupBy(key).pivot("field", fields).agg(last)
    wide = own.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    count = sum((F.col(f"_new_{f}").isNotNull().cast("int") for f in fields), F.lit(0))
    joined = df.join(wide, key, "left").withColumn("_applied", count.cast("long"))
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f"_new_{f}").cast(df.schema[f].dataType), F.col(f)))
    return joined.drop(*[f"_new_{f}" for f in fields])


def best_in_set(df: DataFrame, fields: list[str]) -> DataFrame:
    """Marks rows that hold the lowest value of a compared set."""
    low = df.agg(*[F.min(f).alias(f"_low_{f}") for f in fields])
    return df.join(F.broadcast(low)).select(df["*"], *[(F.col(f) == F.col(f"_low_{f}")).alias(f"best_{f}") for f in fields])


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    """The different values of a column that aren't missing or empty, in order."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != "")).select(value).distinct().orderBy(value)


def quality_of_six(people: DataFrame, group: list[str]) -> DataFrame:
    """Per group: whole per cent of six fields that are declared."""
    return people.groupBy(*group).agg(filled_share([F.col(c) for c in SIX]).alias("quality"))


def secured(df: DataFrame, active: str = "is_active") -> DataFrame:
    return df.where(F.col(active))


def missing_financials(df: DataFrame) -> DataFrame:
    return df.where((F.col("assets") == 0) & (F.col("liabilities") == 0) & declared(F.col("url")))


def missing_occupation(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("occupation"), F.lit("")).isin("", UNKNOWN))


def denormalised(people: DataFrame, parties: DataFrame, contests: DataFrame, instead: dict[str, str] | None = None) -> DataFrame:
    """People with their party and contest as structs; unmatched ones stay null, but for what a page shows `instead` of a party.

    Spark broadcasts either side where its size allows.
    """
    p = parties.select(F.col("id").alias("party"), F.struct("*").alias("party_info"))
    c = contests.select(F.col("id").alias("contest"), F.struct("*").alias("contest_info"))
    joined = people.join(p, "party", "left").join(c, "contest", "left")
    if instead is None:
        return joined
    none = F.struct(*[F.lit(instead.get(f.name)).cast(f.dataType).alias(f.name) for f in parties.schema])
    return joined.withColumn("party_info", F.coalesce("party_info", none))
