"""Matching entities by names, ranges and spines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalar import person_key
from tallyforge.operators.keys import numbered


def token_match(wanted: DataFrame, pool: DataFrame, within: str, wanted_name: str, pool_name: str, order: str) -> DataFrame:
    """Each wanted row with the first pool row of its group whose normalised name is equal, else whose tokens hold or lie in its own.

    A name without any token matches nothing. Both sides are reduced to the distinct names of a group; equal names meet
    by an equi-join, and those without one meet by the rarest token of the shorter name.
    """
    first = lambda rows: F.min_by(rows, F.col(f"{rows}._order")).alias("_first")
    p = pool.select(F.col(within).alias("_g"), person_key(F.col(pool_name)).alias("_key"), F.struct(F.struct(order).alias("_order"), F.struct(*[F.col(c) for c in pool.columns]).alias("match")).alias("_row"))
    p = p.where("_key <> ''").groupBy("_g", "_key").agg(first("_row"))
    keyed = wanted.withColumn("_key", person_key(F.col(wanted_name)))
    w = keyed.where("_key <> ''").select(F.col(within).alias("_g"), "_key").distinct()
    equal = w.join(p, ["_g", "_key"]).select("_g", "_key", "_first.match", F.lit(1).cast("long").alias("pass"))
    # The second pass depends on a name's set of tokens and their number alone.
    tokens = F.split("_key", " ")
    w = w.join(p.select("_g", "_key"), ["_g", "_key"], "left_anti").withColumn("_w", F.array_sort(F.array_distinct(tokens))).withColumn("_wn", F.size(tokens))
    p = p.select("_g", F.array_sort(F.array_distinct(tokens)).alias("_p"), F.size(tokens).alias("_pn"), F.col("_first").alias("_row")).groupBy("_g", "_p", "_pn").agg(first("_row"))
    sets = w.select("_g", "_w", "_wn").distinct()
    found = _holding(sets, "_w", p, "_p").where("_wn <= _pn").unionByName(_holding(p, "_p", sets, "_w").where("_pn < _wn"))
    found = found.groupBy("_g", "_w", "_wn").agg(F.min_by("_first", "_first._order").alias("_first"))
    inside = w.join(found, ["_g", "_w", "_wn"]).select("_g", "_key", "_first.match", F.lit(2).cast("long").alias("pass"))
    best = equal.union(inside).withColumnRenamed("_g", within)
    return keyed.join(best, [within, "_key"]).select(*[keyed[c] for c in wanted.columns], "match", "pass")


def _holding(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
    """Pairs of a group whose array s lies in array l, both without repeats, found by the token of s that is rarest among long's."""
    held = long.withColumn("_t", F.explode(l))
    often = held.groupBy("_g", "_t").agg(F.count("*").alias("_often"))
    rest = [F.first(c).alias(c) for c in short.columns if c not in ("_g", s, f"{s}n")]
    rare = short.withColumn("_t", F.explode(s)).join(often, ["_g", "_t"], "left").groupBy("_g", s, f"{s}n").agg(F.min_by("_t", F.struct(F.coalesce("_often", F.lit(0)), "_t")).alias("_t"), *rest)
    return rare.join(held, ["_g", "_t"]).where(F.size(F.array_except(s, l)) == 0).drop("_t")


def any_token_inside(names: str, other: str):
    """Condition: some word of a name stands in another name."""
    return F.exists(F.split(F.lower(F.col(names)), r"\s+"), lambda t: F.contains(F.lower(F.col(other)), t) & (t != ""))


def first_range(df: DataFrame, value: str, ranges: list[tuple[int, int, str]], overrides: dict[int, str] | None = None, default: str = "other", name: str = "label") -> DataFrame:
    """The label of the first range that holds a value, after overrides; a CASE, as the ranges are a fixed list."""
    out = F.lit(default)
    for low, high, label in reversed(ranges):
        out = F.when(F.col(value).between(low, high), label).otherwise(out)
    for v, label in (overrides or {}).items():
        out = F.when(F.col(value) == v, label).otherwise(out)
    return df.withColumn(name, out)


def range_join(df: DataFrame, value: str, ranges: DataFrame, step: int) -> DataFrame:
    """Rows of df with every range (low, high, label) of a table that holds their value: an equi-join on cells of width `step`.

    Ranges are spread over the cells that they touch, so neither side is held against all of the other.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step))))
    return df.withColumn("_cell", F.floor(F.col(value) / step)).join(cells, "_cell").where(F.col(value).between(F.col("low"), F.col("high"))).drop("_cell")


def corrected(df: DataFrame, table: DataFrame, key: str, field: str) -> DataFrame:
    """field replaced by a lookup table's (key, value) where it has one; `_changed` marks rows that differ."""
    j = df.join(table.select(key, F.col("value").alias("_v")), key, "left")
    return j.withColumn("_changed", F.coalesce(F.col("_v") != F.col(field), F.lit(False))).withColumn(field, F.coalesce("_v", field)).drop("_v")


def fanned_out(contests: DataFrame, districts: DataFrame, overrides: DataFrame, key: str, district: str, fields: list[str]) -> DataFrame:
    """District figures at each contest, its own overrides first, with a note where they stand for something else."""
    d = districts.select(F.col(district).alias("_d"), *[F.col(f).alias(f"_d_{f}") for f in fields], F.col("proxy").alias("_proxy"))
    o = overrides.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    j = contests.join(d, contests[district] == d["_d"], "left").join(o, key, "left")
    note = F.when(F.col("_d").isNull(), "no district figures").when(F.col("_proxy").isNotNull(), F.concat(F.lit("figures of "), F.col("_proxy")))
    return j.select(*[F.col(c) for c in contests.columns], *[F.coalesce(f"_o_{f}", f"_d_{f}").alias(f) for f in fields], note.alias("note"))


def gaps(ids: DataFrame, key: str, first: int = 1, beyond: int = 50) -> DataFrame:
    """Ids from `first` to `beyond` past the largest that aren't there."""
    top = ids.agg(F.max(F.col(key).cast("long"))).first()[0] or 0
    spine = ids.sparkSession.range(first, max(first, top + beyond + 1)).withColumnRenamed("id", key)
    return spine.join(ids.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def on_spine(df: DataFrame, keys: DataFrame, column: str, values: list) -> DataFrame:
    """A row for each key and listed value, with df's row where there is one."""
    spine = keys.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return spine.join(df, [*keys.columns, column], "left")


def by_priority(sources: list[DataFrame], per: str) -> DataFrame:
    """Per value of a column, the rows of the first source that has any."""
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("_source", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    first = every.groupBy(per).agg(F.min("_source").alias("_source"))
    return every.join(first, [per, "_source"]).drop("_source")


def chunks(df: DataFrame, order: str, size: int = 50) -> DataFrame:
    """Rows with the number of their batch, in order within ranges of the sort key."""
    return numbered(df, [F.asc_nulls_last(order)], "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")
