"""Contests: who leads, by how much, and what changed since the round before.

Votes are rows (contest, contestant, votes, order); the order column settles ties, and may be the ballot position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import ratio


def standings(votes: DataFrame, contest: list[str], votes_col: str = "votes", order: list[str] | None = None) -> DataFrame:
    """votes with `place`, `total`, `share` (per cent) and `next_votes`, all over one sort per contest."""
    by = Window.partitionBy(*contest).orderBy(F.desc(votes_col), *(order or []))
    whole = Window.partitionBy(*contest)
    return votes.withColumns(
        {
            "place": F.row_number().over(by).cast("long"),
            "next_votes": F.lead(votes_col).over(by),
            "total": F.sum(votes_col).over(whole),
        }
    ).withColumn("share", ratio(votes_col, "total", 100.0))


def winners(votes: DataFrame, contest: list[str], votes_col: str = "votes", order: list[str] | None = None, single: str = "votes") -> DataFrame:
    """The leading row of each contest with `margin`; without a second, the margin is the leader's `votes` or `zero`.

    Each task keeps a contest's first two rows and its sum before the shuffle, so a contest of most rows is no task's.
    """
    by = Window.partitionBy(*contest).orderBy(F.desc(votes_col), *(order or []))
    two = votes.withColumn("place", F.row_number().over(by).cast("long")).where("place <= 2")
    totals = votes.groupBy(*[F.col(c).alias(f"_{c}") for c in contest]).agg(F.sum(votes_col).alias("total"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in contest))
    first = two.withColumn("next_votes", F.lead(votes_col).over(by)).where("place = 1").join(totals, same).drop(*[f"_{c}" for c in contest])
    first = first.withColumn("share", ratio(votes_col, "total", 100.0))
    alone = F.col(votes_col) if single == "votes" else F.lit(0)
    return first.withColumn("margin", F.when(F.col("next_votes").isNull(), alone).otherwise(F.col(votes_col) - F.col("next_votes"))).drop("place", "next_votes")


def live_margin(computed: Column, reported: Column) -> Column:
    """The computed margin if positive, else the reported one."""
    return F.when(computed > 0, computed).otherwise(reported)


def seat_flips(before: DataFrame, now: DataFrame, contest: list[str], party: str = "party") -> DataFrame:
    """Winners of both rounds side by side; held seats too, marked same_party."""
    a = before.select(*contest, F.col(party).alias("from_party"))
    b = now.select(*contest, F.col(party).alias("to_party"), "margin")
    return b.join(a, contest).withColumn("same_party", F.col("from_party") == F.col("to_party"))


def scorecard(before: DataFrame, now: DataFrame, rows_now: DataFrame, party: str = "party") -> DataFrame:
    """Per party: seats before and now, their difference, rows contested, strike rate and mean share of its wins."""
    p = before.groupBy(party).agg(F.count("*").alias("seats_prev"))
    n = now.groupBy(party).agg(F.count("*").alias("seats_now"), F.sum("share").alias("_shares"))
    c = rows_now.groupBy(party).agg(F.count("*").alias("contested"))
    out = p.join(n, party, "full_outer").join(c, party, "full_outer").na.fill(0, ["seats_prev", "seats_now", "contested"])
    return out.select(
        party,
        "seats_prev",
        "seats_now",
        (F.col("seats_now") - F.col("seats_prev")).alias("delta"),
        "contested",
        ratio("seats_now", "contested").alias("strike_rate"),
        ratio(F.coalesce("_shares", F.lit(0.0)), "seats_now").alias("avg_share"),
    )


def retention(before: DataFrame, now: DataFrame, contest: list[str], party: str = "party") -> DataFrame:
    """Per party: seats retained, gained and lost between two rounds, over contests of both."""
    both = seat_flips(before, now, contest, party)
    kept = both.where("same_party").groupBy(F.col("to_party").alias(party)).agg(F.count("*").alias("retained"))
    gained = both.where("not same_party").groupBy(F.col("to_party").alias(party)).agg(F.count("*").alias("gained"))
    lost = both.where("not same_party").groupBy(F.col("from_party").alias(party)).agg(F.count("*").alias("lost"))
    out = kept.join(gained, party, "full_outer").join(lost, party, "full_outer").na.fill(0)
    return out.withColumn("delta", F.col("gained") - F.col("lost"))


def swing_delta(flips: DataFrame) -> DataFrame:
    """Seats that moved between each pair of parties."""
    return flips.where("not same_party").groupBy("from_party", "to_party").agg(F.count("*").alias("moved"))


def historical_result(votes: DataFrame, contest: list[str], name: str, place: str, none_of_above: Column, top: int = 5) -> DataFrame:
    """Per contest: winner and runner-up by ballot place without the none-of-the-above rows, totals with them, the first `top`."""
    real = votes.withColumn("_real", ~none_of_above)
    ranked = real.withColumn("_p", F.row_number().over(Window.partitionBy(*contest, "_real").orderBy(place)))
    pick = lambda k, c: F.max(F.when(F.col("_real") & (F.col("_p") == k), F.col(c)))
    out = ranked.groupBy(*contest).agg(
        pick(1, name).alias("winner"),
        pick(2, name).alias("runner_up"),
        pick(1, "votes").alias("_first"),
        pick(2, "votes").alias("_second"),
        F.sum("votes").alias("total_votes"),
        F.array_sort(F.collect_list(F.when(F.col("_real") & (F.col("_p") <= top), F.struct("_p", F.col(name).alias("name"), "votes")))).alias("top"),
    )
    margin = F.col("_first") - F.coalesce("_second", F.lit(0))
    return out.withColumn("margin_votes", margin).withColumn("margin_pct", F.floor(ratio(margin, "total_votes", 100.0) * 100 + 0.5) / 100).drop("_first", "_second")


def others_collapsed(shares: DataFrame, party: str, value: str, share: str, after: int = 4, below: float = 2.0) -> DataFrame:
    """Small parties after the first places become one row, Others."""
    first = shares.orderBy(F.desc(value), party).limit(after).select(party, F.lit(True).alias("_first"))
    small = F.col("_first").isNull() & (F.col(share) < below)
    marked = shares.join(F.broadcast(first), party, "left")
    return marked.withColumn("_name", F.when(small, "Others").otherwise(F.col(party))).groupBy(F.col("_name").alias(party)).agg(F.sum(value).alias(value), F.sum(share).alias(share))


def sweeps(winners_df: DataFrame, contests: DataFrame, district: str, contest: str, party: str, least: int = 3) -> DataFrame:
    """Districts whose contests all report, at least `least` of them, all won by one party."""
    every = contests.groupBy(district).agg(F.count("*").alias("contests"))
    own = winners_df.groupBy(district).agg(F.count("*").alias("reporting"), F.count_distinct(party).alias("parties"), F.min(party).alias("party"))
    return every.join(own, district).where(f"contests = reporting and parties = 1 and reporting >= {least}").select(district, "party", "reporting")


def notable_wins(now_rows: DataFrame, now: DataFrame, before: DataFrame, contest: str, name: str, known: DataFrame, cap: int = 3) -> DataFrame:
    """Biggest and tightest margins, incumbents beaten and first-time winners, each kind capped in contest order."""
    big = now.orderBy(F.desc("margin"), contest).limit(1).withColumn("kind", F.lit("biggest_margin"))
    small = now.orderBy("margin", contest).limit(1).withColumn("kind", F.lit("tightest_margin")).join(big.select(contest), contest, "left_anti")
    old = before.select(contest, F.lower(name).alias("_old"))
    again = now_rows.select(contest, F.lower(name).alias("_old")).distinct()
    beaten = now.join(old.join(again, [contest, "_old"], "left_semi"), contest).where(F.lower(name) != F.col("_old")).drop("_old").withColumn("kind", F.lit("incumbent_loss"))
    names = known.select(F.lower(name).alias("_name")).distinct()
    fresh = now.withColumn("_name", F.lower(name)).join(names, "_name", "left_anti").drop("_name").withColumn("kind", F.lit("first_time_winner"))
    few = lambda df: df.orderBy(contest).limit(cap)
    columns = ["kind", contest, name, "margin"]
    return big.select(columns).union(small.select(columns)).union(few(beaten).select(columns)).union(few(fresh).select(columns))


#: Ranges of values, about equal in rows, that the exact quartiles are sought in.
RANGES, QUARTILES = 64, (0.25, 0.5, 0.75)


def quartile_cuts(df: DataFrame, value: str) -> DataFrame:
    """One row q1, q2, q3: the values at places floor(n q) of the sorted non-null values."""
    # Exact order statistics without gathering the column: counts of distinct values over ranges that a quantile sketch
    # makes about equal; only the ranges in which the places lie are sorted.
    n = df.where(F.col(value).isNotNull())
    sketch = n.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)]).alias("splits"), F.count("*").alias("n"))
    runs = n.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")).join(F.broadcast(sketch))
    runs = runs.select("v", "k", "n", F.size(F.filter("splits", lambda s: s < F.col("v"))).alias("part"))
    sums = runs.groupBy("part").agg(F.sum("k").alias("t"), F.first("n").alias("n"))
    # One row for each range.
    before = sums.withColumn("before", F.sum("t").over(Window.orderBy("part")) - F.col("t"))
    place = lambda q: F.floor(F.col("n") * q)
    holds = reduce(lambda x, y: x | y, ((F.col("before") <= place(q)) & (place(q) < F.col("before") + F.col("t")) for q in QUARTILES))
    inside = runs.join(F.broadcast(before.where(holds).select("part", "before")), "part")
    inside = inside.withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("part").orderBy("v")))
    at = lambda q: F.min(F.when(F.col("upto") > place(q), F.col("v")))
    return inside.agg(*[at(q).alias(f"q{i}") for i, q in enumerate(QUARTILES, 1)])


def quartile_name(value: Column) -> Column:
    return F.when(value <= F.col("q1"), "Q1 (lowest)").when(value <= F.col("q2"), "Q2").when(value <= F.col("q3"), "Q3").otherwise("Q4 (highest)")


def slices(rows: DataFrame, named: list[str], measured: list[str], cuts_over: DataFrame, party: str = "party") -> DataFrame:
    """Seats by (dimension, bucket, party): named columns as they are, measured ones by quartile over cuts_over."""
    out = rows
    for c in measured:
        # One row per measure.
        out = out.join(F.broadcast(quartile_cuts(cuts_over, c))).withColumn(f"_b_{c}", F.when(F.col(c).isNotNull(), quartile_name(F.col(c)))).drop("q1", "q2", "q3")
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("bucket")) for c in named] + [F.struct(F.lit(c).alias("dimension"), F.col(f"_b_{c}").alias("bucket")) for c in measured]
    long = out.select(party, F.explode(F.array(*pairs)).alias("x")).select(party, "x.dimension", "x.bucket").where("bucket is not null")
    return long.groupBy("dimension", "bucket", party).agg(F.count("*").alias("seats"))


def majority(seats: DataFrame, least: int, party: str = "party", value: str = "seats") -> DataFrame:
    """The party that has reached a majority, if any."""
    return seats.where(F.col(value) >= least).orderBy(F.desc(value), party).limit(1)


def majority_state(parties: DataFrame, least: int) -> DataFrame:
    """The party ahead in most contests (party, seats, won) once it leads or has won a majority, and which of both."""
    top = parties.orderBy(F.desc("seats"), "party").limit(1)
    return top.select("party", "seats", "won", (F.col("seats") >= least).alias("projected"), (F.col("won") >= least).alias("confirmed")).where("projected or confirmed")


def extremes(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The largest gainer and loser: rows kind, tie, value; only rises and falls count."""
    up = df.where(F.col(value) > 0).orderBy(F.desc(value), tie).limit(1).select(F.lit("gainer").alias("kind"), tie, value)
    down = df.where(F.col(value) < 0).orderBy(value, tie).limit(1).select(F.lit("loser").alias("kind"), tie, value)
    return up.union(down)
