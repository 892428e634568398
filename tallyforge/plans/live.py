"""The live run: landed pages to contest documents, the summary and the run's bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalar import name_key
from tallyforge.operators import keys, live
from tallyforge.sources import pages
from tallyforge.streaming.live import upsert_latest
from tallyforge.streaming.state import State

#: The status row of a scheduled run.
RUN = "status string, reset long, rows long, unmatched long, written long"


def contest_documents(state_pages: DataFrame, card_pages: DataFrame, party_pages: DataFrame, contests: DataFrame, aliases: dict[str, str], number_in_url: str = r"(\d+)\.htm") -> DataFrame:
    """Pages (url, html) of a scrape to one document per contest; contests: id, key (name_key of the name), number."""
    rows = pages.statewise(state_pages)
    found = live.cascade(rows, contests, name_key("ac_name"), "ac_number", aliases)
    cards = pages.cards(card_pages).withColumn("ac_number", F.regexp_extract("url", number_in_url, 1).cast("int"))
    return live.documents(found, cards, pages.partywise(party_pages))


def entered(updates: DataFrame, known: DataFrame, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Updates by hand (id, at, contestants, declared): the documents after them, the rejected rows with reasons, the reduced summary.

    The last valid update of a contest counts; stored documents without one stay.
    """
    seen = live.checked(updates, known)
    new = live.entered(keys.keep_one(seen.where("reason is null"), ["id"], "at", "last"))
    after = stored.join(new.select("id"), "id", "left_anti").unionByName(new)
    none = stored.select("id", F.lit(None).cast("string").alias("declared_at")).limit(0)
    return after, seen.where("reason is not null").select("id", "at", "reason"), live.summary(after, none, now, reduced=True)


def scheduled(state: State, documents: DataFrame, phase: str | None, number: int, at: str, tie: str, dry: bool = False, reset: bool = False) -> DataFrame:
    """One run of the schedule over documents that may lack an id: its status row (status, reset, rows, unmatched, written).

    Outside the live phase nothing happens (skipped). reset drops every key before; dry only counts what the run has
    read. A number that has run already writes nothing again.
    """
    spark = documents.sparkSession
    if live.phase(phase) != "live":
        return spark.createDataFrame([("skipped", 0, 0, 0, 0)], RUN)
    dropped = state.read().count() if reset else 0
    if reset:
        state.reset()
    counts = documents.agg(F.count("*").alias("rows"), F.count_if(F.col(state.key).isNull()).alias("unmatched")).first()
    if dry:
        return spark.createDataFrame([("dry", dropped, counts["rows"], counts["unmatched"], 0)], RUN)
    known = documents.where(F.col(state.key).isNotNull())
    upsert_latest(state, at, tie, source="schedule")(known, number)
    status = spark.createDataFrame([(dropped, counts["rows"], counts["unmatched"], counts["rows"] - counts["unmatched"])], "reset long, rows long, unmatched long, written long")
    return status.select(live.run_status(F.col("written"), F.col("unmatched")).alias("status"), "reset", "rows", "unmatched", "written")


def run(documents: DataFrame, previous: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The summary over this run's documents, and the run's status row."""
    status = documents.agg(F.count("*").alias("written"), F.count_if(F.col("id").isNull()).alias("unmatched"))
    return live.summary(documents, previous, now), status.withColumn("status", live.run_status(F.col("written"), F.col("unmatched")))
