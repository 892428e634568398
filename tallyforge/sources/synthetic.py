"""A seeded generator of contest rounds for dry runs: a sequential stream of draws, so it is small and driver-side."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def seeded_round(spark: SparkSession, contests: list[str], base: dict[str, dict[str, float]], swing: dict[str, float], seed: int = 42) -> DataFrame:
    """Votes (contest, party, votes, declared): base shares and swings in points, noise of up to 1.5 points either way.

    Of each contest one draw tells whether it is declared (85 in 100 are), one follows for each contestant and one for
    the votes cast; a share is half a point at least before all are brought to a sum of 1.
    """
    state, rows = seed, []

    def draw() -> float:
        nonlocal state
        state = (state * 9301 + 49297) % 233280
        return state / 233280

    for contest in contests:
        declared = draw() > 0.15
        shares = {p: max(0.5, s + swing.get(p, 0.0) + (draw() - 0.5) * 3) for p, s in base[contest].items()}
        total, cast = sum(shares.values()), math.floor(180_000 + draw() * 60_000 + 0.5)
        rows += [(contest, p, math.floor(s / total * cast + 0.5), declared) for p, s in shares.items()]
    return spark.createDataFrame(rows, "contest string, party string, votes long, declared boolean")
