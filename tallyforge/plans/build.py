"""The offline build: candidates with patches and incumbents, history by priority, figures of districts at contests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalar import place_key
from tallyforge.operators import contest, matching, people
from tallyforge.sources.files import chosen_history


def candidates(raw: DataFrame, overrides: DataFrame, fields: list[str], winners: DataFrame, contests: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Candidates with overrides applied and last round's winners marked as incumbents.

    winners: ac_name, district, winner; contests: id, name, district. Names that several contests share are told apart
    by district.
    """
    c = people.patched(raw, overrides, fields)
    keyed = contests.select(F.col("id").alias("contest"), place_key("name").alias("_k"), F.col("district").alias("_d"))
    w = winners.select(place_key("ac_name", aliases).alias("_k"), F.col("district").alias("_d"), "winner")
    exact = w.join(keyed, ["_k", "_d"]).select("contest", "winner")
    alone = keyed.groupBy("_k").agg(F.min("contest").alias("contest"), F.count("*").alias("_n")).where("_n = 1")
    by_name = w.join(keyed, ["_k", "_d"], "left_anti").join(alone, "_k").select("contest", "winner")
    sitting = matching.token_match(exact.union(by_name), c.select("contest", "name", "id"), "contest", "winner", "name", "id")
    return c.join(sitting.select(F.col("match.id").alias("id"), F.lit(True).alias("_sits")), "id", "left").withColumn("incumbent", F.coalesce("_sits", F.lit(False))).drop("_sits")


def history(wide: DataFrame, plain: DataFrame, winners: DataFrame, last_year: int) -> DataFrame:
    rows = chosen_history(wide, plain, winners, last_year)
    return contest.historical_result(rows, ["year", "ac_number"], "candidate", "position", F.col("candidate") == "NOTA")


def demographics(contests: DataFrame, districts: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    return matching.fanned_out(contests, districts, overrides, "id", "district", fields)
