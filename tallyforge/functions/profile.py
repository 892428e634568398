"""Scores and flags of a contestant's profile, as columns over its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.scalar import half_up

UNKNOWN = "Not declared"
#: Marks of each education tier, looked for in lower case; the highest tier that matches counts.
TIERS = {
    4: ("phd", "doctorate", "doctor of"),
    3: ("post graduate", "postgraduate", " pg ", "^pg", "mba", "m.a", "m.sc", "m.com", "llm", "m.tech", "master"),
    2: ("graduate", "bachelor", "b.a", "b.sc", "b.com", "b.tech", "be ", "llb", "mbbs", "degree"),
    1: ("12th", "hsc", "higher secondary", "intermediate", "10+2", "class xii", "10th", "ssc", "matriculate", "class x", "8th", "5th"),
}
LABELS = {1: "10th/12th pass", 2: "Graduate", 3: "Post Graduate", 4: "PhD/Doctorate"}
BUCKETS = [(1_000_000, "Low"), (10_000_000, "Medium"), (100_000_000, "High")]
HIGH_ASSETS, EXTREME_ASSETS, MANY_CASES = 500_000_000, 2_000_000_000, 20


def declared(x: Column) -> Column:
    """Neither missing, empty, zero nor the word for not declared."""
    return F.coalesce(~x.cast("string").isin("", "0", UNKNOWN), F.lit(False))


def education_tier(education: Column) -> Column:
    text, out = F.lower(education), F.lit(0)
    for tier in sorted(TIERS):
        hits = [F.startswith(text, F.lit(m[1:])) if m[0] == "^" else F.contains(text, F.lit(m)) for m in TIERS[tier]]
        any_of = hits[0]
        for h in hits[1:]:
            any_of = any_of | h
        out = F.when(any_of, tier).otherwise(out)
    return F.when(declared(education), out).otherwise(0)


def integrity(cases: Column, education: Column, url: Column) -> Column:
    """100, less 15 per case up to 60, plus 5 per education tier and 5 for a filed affidavit, within 0 and 100."""
    score = 100 - F.least(F.greatest(cases, F.lit(0)) * 15, F.lit(60)) + 5 * education_tier(education) + F.when(declared(url), 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def final_score(alignment: Column, integrity_score: Column) -> Column:
    return half_up(alignment.cast("double") * 0.6 + integrity_score.cast("double") * 0.4)


def reasons(cases: Column, education: Column, url: Column) -> tuple[Column, Column]:
    """Penalty and bonus reasons as lists; a standard bonus where there is nothing to say."""
    tier = education_tier(education)
    penalty = F.array_compact(F.array(F.when(cases > 0, F.format_string("−%d for %d pending criminal case%s", F.least(cases * 15, F.lit(60)).cast("long"), cases.cast("long"), F.when(cases > 1, "s").otherwise("")))))
    label = F.lit("")
    for t, name in LABELS.items():
        label = F.when(tier == t, name).otherwise(label)
    bonus = F.array_compact(F.array(F.when(tier > 0, F.format_string("+%d for %s education", (tier * 5).cast("long"), label)), F.when(declared(url), F.lit("+5 for affidavit on public record"))))
    empty = (F.size(penalty) == 0) & (F.size(bonus) == 0)
    return penalty, F.when(empty, F.array(F.lit("Standard profile — no declared criminal cases"))).otherwise(bonus)


def asset_bucket(assets: Column) -> Column:
    out = F.lit("Very High")
    for limit, name in reversed(BUCKETS):
        out = F.when(assets < limit, name).otherwise(out)
    return out


def flags(cases: Column, age: Column, education: Column, url: Column, assets: Column, liabilities: Column) -> Column:
    """What is odd or missing about a profile, as a list."""
    crore = half_up(assets / F.lit(10_000_000.0)).cast("string")
    return F.array_compact(
        F.array(
            F.when(~declared(url), F.lit("Missing affidavit URL")),
            F.when(F.coalesce(age, F.lit(0)) < 18, F.lit("Age not declared or invalid")),
            F.when(~declared(education), F.lit("Education not declared")),
            F.when((assets == 0) & (liabilities == 0), F.lit("Asset data not available")),
            F.when(assets > EXTREME_ASSETS, F.concat(F.lit("Extremely high assets: ₹"), crore, F.lit(" Cr declared"))).when(assets > HIGH_ASSETS, F.concat(F.lit("High assets: ₹"), crore, F.lit(" Cr declared"))),
            F.when(cases > MANY_CASES, F.concat(cases.cast("string"), F.lit(" pending criminal cases declared"))),
        )
    )


def severity(found: Column, cases: Column, assets: Column) -> Column:
    return F.when((cases > MANY_CASES) | (assets > EXTREME_ASSETS), "alert").when(F.size(found) > 2, "warn").otherwise("clean")


def filled_share(fields: list[Column]) -> Column:
    """Aggregate: whole per cent of the fields that are declared; 0 for no rows."""
    filled = F.sum(sum((declared(f).cast("long") for f in fields), F.lit(0).cast("long")))
    every = F.count(F.lit(1)) * len(fields)
    return F.coalesce(F.when(every > 0, half_up(filled / every * 100)), F.lit(0).cast("long"))
