"""Read queries behind the entry points: listings with totals, one contest's insights, the quiz, live documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import people, quiz, search
from tallyforge.sources.files import envelope
from tallyforge.sources.pages import feed


def candidates(rows: DataFrame, parties: DataFrame, contests: DataFrame, contest: str = "", party: str = "") -> DataFrame:
    return envelope(people.denormalised(people.equal_to(rows, contest=contest, party=party), parties, contests))


def candidate(rows: DataFrame, parties: DataFrame, contests: DataFrame, wanted: str) -> DataFrame:
    """One row, or none for an unknown id."""
    return people.denormalised(rows.where(F.col("id") == wanted), parties, contests)


def contests(rows: DataFrame, q: str = "", district: str = "") -> DataFrame:
    return envelope(search.contains_either(rows, q, "name", "name_bn", district=district))


def insights(rows: DataFrame, contest: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Figures, histograms (of: education or assets, bucket, n) and facts of one contest; nothing for an unknown one."""
    own = rows.where(F.col("contest") == contest)
    named = lambda df, of: df.select("contest", F.lit(of).alias("of"), "bucket", "n")
    histograms = named(people.education_histogram(own, ["contest"]), "education").unionByName(named(people.asset_histogram(own, ["contest"]), "assets"))
    return people.insights(own, ["contest"]), histograms, people.facts(own, "contest")


def questions(rows: DataFrame) -> DataFrame:
    return quiz.public_questions(rows)


def news(pages: DataFrame, for_contest: bool) -> DataFrame:
    return feed(pages, 10 if for_contest else 6)


def live_state(summary: DataFrame, meta: DataFrame) -> DataFrame:
    """The newest summary beside the run's meta row."""
    return summary.withColumn("_one", F.lit(1)).join(meta.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def live_result(documents: DataFrame, contest: str) -> DataFrame:
    return documents.where(F.col("id") == contest)
