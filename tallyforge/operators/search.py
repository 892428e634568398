"""Search over names: tiers of exactness, sound and typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalar import sound_key


def _most(query: Column) -> Column:
    """Typing errors that a query allows."""
    return F.floor(F.length(query) * 0.35).cast("int")


def _parts(text: Column, collapse: bool) -> Column:
    """What of a text answers queries: it in lower case, its words, how it sounds and how its words do."""
    t = F.lower(text)
    sound = sound_key(t, collapse)
    return F.struct(t.alias("t"), F.split(t, r"\s+").alias("words"), sound.alias("sound"), F.split(sound, " ").alias("sounds"))


def _scored(of: Column, q: Column, pq: Column) -> Column:
    """How well the parts of a text answer a query in lower case that sounds like pq."""
    most = _most(q)

    def typo(parts: Column, key: Column) -> Column:
        near = lambda w: (F.abs(F.length(w) - F.length(key)) <= most + 1) & (F.levenshtein(w, key) <= most)
        return (F.length(q) >= 3) & F.exists(parts, near)

    return (
        F.when(of["t"] == q, 100)
        .when(F.startswith(of["t"], q), 90)
        .when(F.exists(of["words"], lambda w: F.startswith(w, q)), 82)
        .when(F.contains(of["t"], q), 75)
        .when(F.exists(of["words"], lambda w: F.contains(w, q)), 65)
        .when(F.contains(of["sound"], pq), 60)
        .when(F.exists(of["sounds"], lambda w: F.startswith(w, pq)), 55)
        .when(typo(of["words"], q), 45)
        .when(typo(of["sounds"], pq), 40)
        .otherwise(0)
        .cast("double")
    )


def score(text: Column, query: str, collapse: bool = True) -> Column:
    """How well a text answers a query, 0 to 100: equal, prefix, word prefix, inside, by sound, by few typing errors."""
    # The parts are bound once; the sound key of a constant query is folded by the optimiser.
    q = F.lit(query.lower())
    return F.get(F.transform(F.array(_parts(text, collapse)), lambda of: _scored(of, q, sound_key(q, collapse))), F.lit(0))


def ranked_search(df: DataFrame, query: str, weights: dict[str, float], tie: str, k: int = 5, collapse: bool = True) -> DataFrame:
    """The k best rows by the largest weighted score of their columns."""
    return ranked_searches(df, [query], weights, tie, k, collapse).drop("query")


def _best(asked: DataFrame, weights: dict[str, float], tie: str, k: int) -> DataFrame:
    """Of rows with a query each (query, _q, _pq, and _of_i for the i-th column), the k best of every query.

    Spark cuts each task's rows to k before the shuffle.
    """
    scores = [_scored(F.col(f"_of_{i}"), F.col("_q"), F.col("_pq")) * w for i, w in enumerate(weights.values())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), tie))
    found = asked.withColumn("score", best).where("score > 0").drop("_q", "_pq", *[f"_of_{i}" for i in range(len(weights))])
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _read(df: DataFrame, weights: dict[str, float], collapse: bool) -> DataFrame:
    return df.withColumns({f"_of_{i}": _parts(F.col(c), collapse) for i, c in enumerate(weights)})


def ranked_searches(df: DataFrame, queries: list[str], weights: dict[str, float], tie: str, k: int = 5, collapse: bool = True) -> DataFrame:
    """The k best rows of each of a few queries, in one pass over the rows, whose words and sounds are made once."""
    asked = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(q.lower()).alias("_q"), sound_key(F.lit(q.lower()), collapse).alias("_pq")) for q in queries])
    rows = _read(df, weights, collapse).withColumn("_asked", F.explode(asked))
    return _best(rows.select("*", "_asked.*").drop("_asked"), weights, tie, k)


def _deleted(word: Column, most: Column) -> Column:
    """The word and what up to `most` deletions make of it."""
    drop = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    step = lambda all_, _: F.array_distinct(F.concat(all_, F.flatten(F.transform(F.filter(all_, lambda x: F.length(x) > 0), drop))))
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.array(word), step)).otherwise(F.array(word))


def _grams(word: Column) -> Column:
    """All runs of one to three characters of a word."""
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i, n=n: F.substring(word, i, F.lit(n))) for n in (1, 2, 3)]
    return F.array_distinct(F.flatten(F.array(*runs)))


def word_answers(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, query): words of names that may answer a query: they hold its longest part, or lie few typing errors from it.

    words: word; asked: query, key (as it is written or sounds), most. A held part has its first three characters in the
    word's runs; two words n errors apart meet in what n deletions make of each. Both meet by equal keys, so no word is held
    against every query.
    """
    part = F.array_max(F.transform(F.split("key", r"\s+"), lambda p: F.struct(F.length(p), p.alias("p"))))["p"]
    parts = asked.select("query", part.alias("part")).withColumn("gram", F.substring("part", 1, 3))
    inside = words.select("word", F.explode(_grams(F.col("word"))).alias("gram")).join(parts, "gram").where(F.contains("word", F.col("part"))).select("word", "query")
    # A query of n characters allows 0.35 n errors, so a word of m answers none that allows more than 0.35 / 0.65 m of them.
    reach = F.floor(F.length("word") * 0.35 / 0.65).cast("int")
    edges = asked.where(F.length("query") >= 3).select("query", "key", "most", F.explode(_deleted(F.col("key"), F.col("most"))).alias("left"))
    near = words.select("word", F.explode(_deleted(F.col("word"), reach)).alias("left")).join(edges, "left")
    near = near.where((F.abs(F.length("word") - F.length("key")) <= F.col("most") + 1) & (F.levenshtein("word", "key") <= F.col("most"))).select("word", "query")
    return inside.union(near).distinct()


def indexed_searches(df: DataFrame, questions: DataFrame, name: str, key: str, k: int = 5, collapse: bool = True) -> DataFrame:
    """The k best rows of every question of a table (query), as ranked_searches gives them, for any number of questions.

    Questions meet the names' distinct words, which grow far slower than the names; only names with a word that may answer
    are scored. key: tells rows of df apart.
    """
    asked = questions.select("query").distinct().withColumn("_q", F.lower("query"))
    kinds = ((F.lower(name), F.col("_q"), r"\s+"), (sound_key(F.lower(name), collapse), sound_key(F.col("_q"), collapse), " "))
    found = None
    for text, own, gap in kinds:
        words = df.select(key, F.explode(F.array_distinct(F.split(text, gap))).alias("word"))
        keyed = asked.select("query", own.alias("key"), _most(F.col("_q")).alias("most"))
        hits = words.join(word_answers(words.select("word").distinct(), keyed), "word").select(key, "query")
        found = hits if found is None else found.union(hits)
    asked = asked.withColumn("_pq", sound_key(F.col("_q"), collapse))
    return _best(_read(df, {name: 1.0}, collapse).join(found.distinct().join(asked, "query"), key), {name: 1.0}, key, k)


def contains_either(df: DataFrame, query: str, latin: str, other: str, **equal: str) -> DataFrame:
    """Rows whose Latin name holds the query in any case, or whose other name holds it as written."""
    out = df.where(F.contains(F.lower(latin), F.lit(query.lower())) | F.contains(F.col(other), F.lit(query))) if query else df
    for c, v in equal.items():
        out = out.where(F.col(c) == v) if v else out
    return out


def mixed_hits(places: DataFrame, people: DataFrame, query: str, order: str = "id", k_places: int = 4, k_people: int = 6) -> DataFrame:
    """The first places and people whose names hold a query of two characters or more."""
    q = query.strip().lower()
    hit = F.contains(F.lower("name"), F.lit(q)) & F.lit(len(q) >= 2)
    part = lambda df, kind, k: df.where(hit).orderBy(order).limit(k).select(F.lit(kind).alias("kind"), F.col(order).cast("string").alias("id"), "name")
    return part(places, "place", k_places).unionByName(part(people, "person", k_people))
