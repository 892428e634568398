"""Orders, small summaries and shapes of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalar import ratio


def newest_declared() -> list[Column]:
    """Declared first by falling time; the rest, without a time, by falling margin."""
    return [F.desc_nulls_last("declared_at"), F.desc("margin"), F.asc("id")]


def flagged_first(flag: str, value: str, tie: str, up: bool = False) -> list[Column]:
    """Rows with the flag first, then by value, missing ones last."""
    return [F.desc(flag), F.asc_nulls_last(value) if up else F.desc_nulls_last(value), F.asc(tie)]


def in_listed_order(value: str, names: list[str]) -> list[Column]:
    """By place in a fixed list; what isn't listed follows by name."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(value))
    return [F.when(place == 0, len(names) + 1).otherwise(place).asc(), F.asc(value)]


def by_rank_of(value: str, ranks: dict[str, int], tie: str) -> list[Column]:
    """By falling rank that a dictionary gives; unknown names have rank 0."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col(value)), F.lit(0))
    return [rank.desc(), F.asc(tie)]


def ends(df: DataFrame, value: str, tie: str, k: int = 5) -> DataFrame:
    """The k highest and k lowest rows that have a value."""
    have = df.where(F.col(value).isNotNull())
    top = have.orderBy(F.desc(value), tie).limit(k).withColumn("end", F.lit("top"))
    return top.union(have.orderBy(F.asc(value), F.desc(tie)).limit(k).withColumn("end", F.lit("bottom")))


def mean_present(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value) > 0).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count("*").alias("n"))


def split_counts(df: DataFrame, key: str, inside: list) -> DataFrame:
    """Rows whose key is in a set, and the rest."""
    return df.agg(F.count_if(F.col(key).isin(inside)).alias("inside"), F.count_if(~F.col(key).isin(inside)).alias("outside"))


def without(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows but those of a fixed set of ids."""
    return df.where(~F.col(key).isin(ids)) if ids else df


def net_worth(assets: Column, liabilities: Column) -> Column:
    """Net assets with their sign's class and size."""
    net = assets - liabilities
    return F.struct(net.alias("net"), F.when(net < 0, "negative").when(net > 0, "positive").otherwise("none").alias("sign"), F.abs(net).alias("size"))


def frame(points: DataFrame, group: list[str], x: str = "x", y: str = "y", margin: float = 35.0) -> DataFrame:
    """The box around each group's points."""
    return points.groupBy(*group).agg((F.min(x) - margin).alias("left"), (F.min(y) - margin).alias("top"), (F.max(x) + margin).alias("right"), (F.max(y) + margin).alias("bottom"))


def winners_as_results(csv: DataFrame) -> DataFrame:
    """Rows of a winners' file as results without votes: what the file doesn't say is 0, electors of 0 are missing."""
    return csv.select("ac_number", "candidate", "party", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("share"), "margin", F.when(F.col("electors") > 0, F.col("electors")).alias("electors"))


def top_share(totals: DataFrame, party: str = "party", value: str = "votes") -> DataFrame:
    """The party with the largest share of all votes."""
    every = totals.agg(F.sum(value).alias("_all"))
    return totals.join(F.broadcast(every)).select(party, ratio(value, "_all", 100.0).alias("share")).orderBy(F.desc("share"), party).limit(1)


def joined_text(df: DataFrame, group: list[str], value: str, order: str, by: str = ",") -> DataFrame:
    """A group's values as one text in order."""
    got = F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(got, lambda x: x["_v"].cast("string")), by).alias("text"))


def nested(df: DataFrame, group: list[str], order: str, fields: list[str]) -> DataFrame:
    """Each group's rows as one list of structs in order; for groups that are small by nature, as contests of a district."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("_v"))))
    return df.groupBy(*group).agg(F.transform(got, lambda x: x["_v"]).alias("items"))


def encoded(rows: Column) -> Column:
    """Structs as JSON fit for a URL."""
    return F.url_encode(F.to_json(rows))


def decoded(text: Column, schema: str) -> Column:
    """What encoded() made; null for anything else."""
    return F.from_json(F.try_url_decode(text), schema)
