"""Quizzes: weights per option, alignment with parties, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.profile import final_score, integrity
from tallyforge.functions.scalar import half_up


def public_questions(questions: DataFrame) -> DataFrame:
    """Questions without the weights of their options."""
    return questions.withColumn("options", F.transform("options", lambda o: o.dropFields("weights")))


def alignment(answers: DataFrame, weights: DataFrame, session: str = "session") -> DataFrame:
    """Per session and party: whole per cent of the most that all answers could give.

    answers: session, question, option; weights: question, option, party, weight. Unknown answers add nothing but count.
    """
    counts = answers.groupBy(session).agg(F.count("*").alias("_n"))
    total = answers.join(weights, ["question", "option"]).groupBy(session, "party").agg(F.sum("weight").alias("_t"))
    return total.join(counts, session).select(session, "party", half_up(F.col("_t") / (F.col("_n") * 10) * 100).alias("score"))


def top_pick(scores: DataFrame, session: str = "session") -> DataFrame:
    """The best-aligned party of each session; of equal ones the first by name."""
    return scores.groupBy(session).agg(F.min_by(F.struct("party", "score"), F.struct(-F.col("score"), "party")).alias("_top")).select(session, "_top.party", "_top.score")


def ranked_people(people: DataFrame, scores: DataFrame, contest: str) -> DataFrame:
    """People of each session's contest by falling final score: their party's alignment and their own integrity.

    scores: session, contest, party, score, all parties of a session; a party without a score has 0.
    """
    sessions = scores.select("session", contest).distinct()
    asked = people.join(sessions, contest).join(scores.select("session", "party", "score"), ["session", "party"], "left")
    final = final_score(F.coalesce("score", F.lit(0)), integrity(F.col("cases"), F.col("education"), F.col("url")))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("final"), "id"))
    return asked.withColumn("final", final).withColumn("place", place.cast("long"))


def with_answer(answers: Column, question: Column, option: Column) -> Column:
    """The list of answers with a question's answer replaced, at the end."""
    return F.concat(F.filter(answers, lambda a: a["question"] != question), F.array(F.struct(question.alias("question"), option.alias("option"))))


def stance_percent(score: Column) -> Column:
    return (score + 2) / 4 * 100
