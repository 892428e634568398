"""Live documents: one row per contest built from scraped tables, summaries of a run, its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import ratio, same_name
from tallyforge.operators.keys import cumulated, placed


def cascade(rows: DataFrame, dim: DataFrame, name_key: Column, number: str, aliases: dict[str, str], dim_name: str = "key", dim_number: str = "number", dim_id: str = "id") -> DataFrame:
    """rows with the id found by name, else by the name's alias, else by number; null if none fits.

    Each key of dim counts once, the last row of a key by its id.
    """
    by_name = dim.groupBy(F.col(dim_name).alias("_k")).agg(F.max(dim_id).alias("_id"))
    by_number = dim.groupBy(F.col(dim_number).alias("_no")).agg(F.max(dim_id).alias("_by_no"))
    other = F.try_element_at(F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair]), name_key) if aliases else F.lit(None).cast("string")
    r = rows.withColumn("_n", name_key).withColumn("_a", other)
    r = r.join(by_name.withColumnsRenamed({"_k": "_n", "_id": "_by_name"}), "_n", "left").join(by_name.withColumnsRenamed({"_k": "_a", "_id": "_by_alias"}), "_a", "left")
    return r.join(by_number, r[number] == by_number["_no"], "left").withColumn(dim_id, F.coalesce("_by_name", "_by_alias", "_by_no")).drop("_n", "_a", "_no", "_by_name", "_by_alias", "_by_no")


def documents(statewise: DataFrame, details: DataFrame, partywise: DataFrame) -> DataFrame:
    """One row per contest of a scrape: contestants in order, leader, margin, total, declared.

    statewise: id, ac_number, lead, lead_party, trail, trail_party, margin, declared; details: ac_number, ord, name,
    party, votes, status; partywise: ac_number, lead, votes. A contest with a detail page uses its rows; without one
    it is a leader and a trailer, with the leader's party-wise votes if the names agree.
    """
    some = statewise.where("not (coalesce(lead, '') = '' and coalesce(trail, '') = '' and margin = 0) and id is not null")
    by = Window.partitionBy("ac_number").orderBy(F.desc("votes"), "ord")
    d = details.withColumn("total", F.sum("votes").over(Window.partitionBy("ac_number"))).withColumn("place", F.row_number().over(by))
    d = d.groupBy("ac_number").agg(
        F.array_sort(F.collect_list(F.struct("place", "name", "party", "votes", ratio("votes", "total", 100.0).alias("share"), "ord"))).alias("_detail"),
        F.bool_or(F.col("status") == "won").alias("_won"),
    )
    p = partywise.groupBy("ac_number").agg(F.max_by(F.struct("lead", "votes"), "votes").alias("_party"))
    r = some.join(d, "ac_number", "left").join(p, "ac_number", "left")
    lead_votes = F.when(same_name(F.col("_party.lead"), F.col("lead")), F.col("_party.votes")).otherwise(F.lit(0)).cast("long")
    trail_votes = F.when((F.col("_lv") > 0) & (F.col("margin") > 0), F.greatest(F.lit(0), F.col("_lv") - F.col("margin"))).otherwise(F.lit(0)).cast("long")
    r = r.withColumn("_lv", lead_votes).withColumn("_tv", trail_votes)
    two = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(n), F.lit("")) != "", F.struct(F.lit(i).alias("place"), F.col(n).alias("name"), F.coalesce(f"{n}_party", F.lit("IND")).alias("party"), F.col(v).alias("votes"), ratio(F.col(v), F.col("_lv") + F.col("_tv"), 100.0).alias("share"), F.lit(i).cast("int").alias("ord")))
                for i, n, v in ((1, "lead", "_lv"), (2, "trail", "_tv"))
            ]
        )
    )
    full = F.size("_detail") > 0
    kind = "array<struct<place:int,name:string,party:string,votes:bigint,share:double,ord:int>>"
    r = r.withColumn("contestants", F.when(full, F.col("_detail").cast(kind)).otherwise(two.cast(kind)))
    gap = F.coalesce(F.get("contestants", F.lit(0))["votes"] - F.get("contestants", F.lit(1))["votes"], F.lit(0))
    return r.select(
        "id",
        "contestants",
        F.get("contestants", F.lit(0))["party"].alias("leader_party"),
        F.get("contestants", F.lit(0))["name"].alias("leader"),
        F.when(full & (gap > 0), gap).otherwise(F.col("margin")).cast("long").alias("margin"),
        F.aggregate("contestants", F.lit(0).cast("long"), lambda a, x: a + x["votes"]).alias("total"),
        (F.coalesce("_won", F.lit(False)) | F.col("declared")).alias("declared"),
    )


def contestant_id(contest: Column, name: Column, party: Column, place: Column) -> Column:
    return F.concat_ws(":", contest, name, F.coalesce(party, F.lit("")), place.cast("string"))


def reshaped(history: DataFrame) -> DataFrame:
    """Historical rows as live ones: winner, runner-up, then other contestants whose names differ from both."""
    rest = F.filter("top", lambda c: (c["name"] != F.col("winner.name")) & (F.col("runner_up").isNull() | (c["name"] != F.col("runner_up.name"))))
    return history.withColumn("contestants", F.concat(F.array_compact(F.array("winner", "runner_up")), F.coalesce(rest, F.array())))


def summary_by_party(leaders: DataFrame, rows: DataFrame, party: str = "party", votes: str = "votes") -> DataFrame:
    """Per party: contests it leads and its votes."""
    lead = leaders.groupBy(party).agg(F.count("*").alias("leading"))
    cast = rows.where(F.col(votes) > 0).groupBy(party).agg(F.sum(votes).alias("votes"))
    return lead.join(cast, party, "full_outer").na.fill(0)


def summary(docs: DataFrame, previous: DataFrame, now: Column, reduced: bool = False) -> DataFrame:
    """One row: contests, declared, and maps and lists over the documents of this run (id, leader, leader_party, margin, declared).

    A contest keeps the declaration time that `previous` (id, declared_at) has. reduced leaves out names, margins
    and winners and lets margins of 0 into the tightest. The maps and lists make one row of every document;
    summary_rows() and tightest() give the same as rows, for any number of them.
    """
    d = summary_rows(docs, previous, now)
    led = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "leader_party"))))
    out = [F.count("*").alias("contests"), F.count_if("declared").alias("declared"), led.alias("leader_by_contest")]
    rest = []
    if not reduced:
        rest = [
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("leader").isNotNull(), F.struct("id", "leader"))))).alias("leader_name"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("margin") > 0, F.struct("id", "margin"))))).alias("margin_by_contest"),
            F.sort_array(F.collect_list(F.when(F.col("declared"), F.struct("declared_at", "id", "leader", "leader_party", "margin"))), asc=False).alias("winners"),
        ]
    few = d.where(F.lit(True) if reduced else F.col("margin") > 0).orderBy("margin", "id", "leader_party").limit(10)
    tight = few.agg(F.array_sort(F.collect_list(F.struct("margin", "id", "leader_party"))).alias("tightest"))
    return d.agg(*out, *rest).crossJoin(tight).select("contests", "declared", "leader_by_contest", "tightest", *[c for c in ("leader_name", "margin_by_contest", "winners") if not reduced])


def summary_rows(docs: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Per document of this run (id, leader, leader_party, margin, declared, declared_at), with the time kept as in summary()."""
    d = docs.join(previous, "id", "left").withColumn("declared_at", F.when(F.col("declared"), F.coalesce("declared_at", now)))
    return d.select("id", "leader", "leader_party", "margin", "declared", "declared_at")


def tightest(docs: DataFrame, k: int = 10, margin: str = "margin", tie: str = "id", zero: bool = False) -> DataFrame:
    return docs.where(F.col(margin) >= 0 if zero else F.col(margin) > 0).orderBy(margin, tie).limit(k)


def declared_and_leading(now: DataFrame, key: str, declared: str, on_hold: DataFrame) -> DataFrame:
    """now's declared rows, and the others without those whose key is on hold; `state` tells which."""
    done = now.where(declared)
    open_ = now.join(done.select(key), key, "left_anti").join(on_hold.select(key), key, "left_anti")
    return done.withColumn("state", F.lit("declared")).unionByName(open_.withColumn("state", F.lit("leading")))


def won_and_leading(docs: DataFrame, before: DataFrame) -> DataFrame:
    """Per party: contests won, leading beyond those, and the change to its seats before."""
    now = docs.groupBy("party").agg(F.count("*").alias("total"), F.count_if("declared").alias("won"))
    out = now.join(before, "party", "full_outer").na.fill(0)
    return out.select("party", "won", F.greatest(F.lit(0), F.col("total") - F.col("won")).alias("leading"), (F.col("total") - F.col("seats_prev")).alias("delta"))


def run_status(written: Column, unmatched: Column) -> Column:
    """ok, partial or error of a run."""
    return F.when(written == 0, "error").when(unmatched > 0, "partial").otherwise("ok")


def checked(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Updates (id, contestants) with the reason to reject each, null if it is valid; contestants without a vote count are dropped."""
    u = updates.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    good = F.filter("contestants", lambda c: c["votes"].isNotNull() & (c["votes"] >= 0))
    why = F.when(F.col("_known").isNull(), "unknown contest").when(F.coalesce(F.size("contestants"), F.lit(0)) <= 0, "no contestants").when(F.size(good) == 0, "no valid contestant")
    return u.withColumn("reason", why).withColumn("contestants", F.coalesce(good, "contestants")).drop("_known")


def banner(declared: Column, is_leader: Column) -> Column:
    return F.when(declared & is_leader, "win").when(declared, "lose").when(is_leader, "lead").otherwise("trail")


def behind(leader_votes: Column, own_votes: Column) -> Column:
    """By how much a contestant is behind the leader."""
    return F.greatest(F.lit(0), leader_votes - own_votes)


def counting_state(total: Column, margin: Column, before: Column, now: Column) -> Column:
    """Of a contest: whether a margin came before its votes, the margin's share of them, flipped or retained."""
    return F.struct(((total == 0) & (margin > 0)).alias("pending"), ratio(margin, total, 100.0).alias("margin_share"), F.coalesce(before != now, F.lit(False)).alias("flipped"), F.coalesce(before == now, F.lit(False)).alias("retained"))


def entered(updates: DataFrame) -> DataFrame:
    """Documents of updates that checked() passed (id, contestants of name, party, votes; declared), most votes first."""
    by_votes = F.array_sort(F.transform("contestants", lambda c, i: F.struct((-c["votes"]).alias("_o"), i.alias("_i"), c["name"].alias("name"), c["party"].alias("party"), c["votes"].alias("votes"))))
    u = updates.withColumn("_s", by_votes).withColumn("total", F.aggregate("contestants", F.lit(0).cast("long"), lambda a, c: a + c["votes"]))
    rows = F.transform("_s", lambda c, i: F.struct(contestant_id(F.col("id").cast("string"), c["name"], c["party"], i).alias("contestant_id"), c["name"].alias("name"), c["party"].alias("party"), c["votes"].alias("votes"), ratio(c["votes"], F.col("total"), 100.0).alias("share")))
    u = u.withColumn("contestants", rows)
    first, second = F.get("contestants", F.lit(0)), F.get("contestants", F.lit(1))
    margin = first["votes"] - F.coalesce(second["votes"], F.lit(0))
    return u.select("id", "contestants", first["party"].alias("leader_party"), first["name"].alias("leader"), margin.alias("margin"), "total", F.coalesce("declared", F.lit(False)).alias("declared"))


def declared_runs(events: DataFrame, key: str, at: str, declared: str, tie: str) -> DataFrame:
    """Start and length of each run of declared rows per key: contiguous in time, ended by a row that isn't.

    Rows that end runs are counted over ranges of time, so a key of most rows is spread too.
    """
    ends = F.when(F.col(declared), 0).otherwise(1)
    runs = cumulated(events, [key], F.col(at).cast("timestamp").cast("double"), [F.col(at), F.col(tie)], ends, "_gap")
    return runs.where(declared).groupBy(key, "_gap").agg(F.min(at).alias("declared_at"), F.count("*").alias("seen")).drop("_gap")


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key, by partial maxima."""
    row = F.struct(*[F.col(c) for c in events.columns])
    return events.groupBy(key).agg(F.max_by(row, F.struct(at, tie)).alias("_row")).select("_row.*")


def nth_event(events: DataFrame, group: str, at: str, tie: str, n: int) -> DataFrame:
    """When each group had its n-th row; a group of most rows is spread over ranges of time."""
    rows = placed(events, [group], F.col(at).cast("timestamp").cast("double"), [F.col(at), F.col(tie)], "_k")
    return rows.where(F.col("_k") == n).drop("_k")


def phase(value: str | None) -> str:
    """pre, live or post; anything else is pre."""
    name = (value or "").strip().lower()
    return name if name in ("pre", "live", "post") else "pre"


def gated(df: DataFrame, value: str | None) -> DataFrame:
    """The rows in the live phase, none otherwise."""
    return df if phase(value) == "live" else df.limit(0)
