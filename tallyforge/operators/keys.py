"""Which of several rows of a key counts, and ranks over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.sources.scratch import scratch

#: Rows of a group that one task may sort.
SMALL = 100_000


def keep_one(df: DataFrame, key: list[str], order: str, keep: str = "first") -> DataFrame:
    """The first or last row of each key by an ordinal, from partial extremes: no sort, no window over a hot key."""
    best = (F.min_by if keep == "first" else F.max_by)(F.struct(*[F.col(c) for c in df.columns]), F.col(order))
    return df.groupBy(*key).agg(best.alias("_row")).select("_row.*")


def kept_few(df: DataFrame, key: list[str], order: str, k: int, keep: str = "first") -> DataFrame:
    """The first k rows by an ordinal (the last k, newest first) after repeats of a key are dropped."""
    one = keep_one(df, key, order, keep)
    return one.orderBy(F.asc(order) if keep == "first" else F.desc(order), *key).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _sorted(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """df with `_part` and `_at`: its range in the order and its place there, from 0; written, so that both stay.

    Ranges are cut by all columns of the order, so rows that share the first ones are spread too, and nulls have the
    place that the order gives them.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    path = scratch(df.sparkSession, "sorted")
    # Columns of the frame may have any name but the two made here.
    ranged.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = df.sparkSession.read.schema(StructType([*df.schema.fields]).add("_id", "long")).parquet(path)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def _before(sizes: DataFrame, n: str) -> DataFrame:
    """(_part, _before) of (_part, n): what lies in the ranges before each; as many rows as ranges."""
    total = F.sum(n).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("_part", F.coalesce(total, F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """1-based places over the whole table by an order: sorted ranges and counts of the ranges before, no single sorted partition."""
    rows = _sorted(df, order, parts)
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), "n")
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_at") + F.col("_before") + 1).cast("long")).drop("_part", "_at", "_before")


def ranked(df: DataFrame, by: str, tie: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based places over the whole table by falling `by`, ties by `tie`; rows without a value come last."""
    return numbered(df, [F.desc_nulls_last(by), F.asc(tie)], name, parts)


def running(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """The sum of `value` over the rows before each in an order, whole table, nulls as 0; only the ranges' sums meet."""
    rows = _sorted(df, order, parts)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = _before(rows.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")), "n")
    return rows.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_at", "_before")


def _ranges(df: DataFrame, at: Column, parts: int) -> Column:
    """The range of a number, of ranges that hold about equal parts of df's rows."""
    cuts = sorted(set(df.select(at.alias("_at")).approxQuantile("_at", [i / parts for i in range(1, parts)], 0.5 / parts)))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)


def _large(df: DataFrame, group: list[str]) -> bool:
    """Whether a group has more rows than one task should sort."""
    return not df.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).isEmpty()


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Condition: equal keys, nulls too; b's columns carry a leading underscore."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in columns))


def _offsets(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Per group and range (at most `parts` rows of a group): rows before it and rows of the group."""
    by = Window.partitionBy(*group)
    before = F.sum("n").over(by.orderBy("_range")) - F.col("n")
    return sizes.select(*[F.col(c).alias(f"_{c}") for c in [*group, "_range"]], F.col("n").alias("_in"), before.alias("_before"), F.sum("n").over(by).alias("_all"))


def placed(df: DataFrame, group: list[str], at: Column, order: list[Column], name: str = "place", parts: int = 256) -> DataFrame:
    """1-based places within each group by rising order; `at` is a number that rises with it.

    Ranges of `at` that hold about equal parts of all rows are sorted on their own and counts give their offsets, so a
    group that holds most rows is spread too; only rows of one value of `at` stay together. Where every group is small,
    it is sorted by itself.
    """
    if not _large(df, group):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    cut = df.withColumn("_range", _ranges(df, at, parts))
    before = _offsets(cut.groupBy(*group, "_range").agg(F.count("*").alias("n")), group)
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    return own.join(before, _same(own, before, [*group, "_range"])).select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))


def cumulated(df: DataFrame, group: list[str], at: Column, order: list[Column], value: Column, name: str, parts: int = 256) -> DataFrame:
    """The sum of `value` up to each row within its group, by rising order; `at` is a number that rises with it.

    As in placed(), ranges are summed on their own, and the sums of the ranges before a row's are added.
    """
    if not _large(df, group):
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("_range", _ranges(df, at, parts)).withColumn("_value", value)
    before = _offsets(cut.groupBy(*group, "_range").agg(F.sum("_value").alias("n")), group)
    own = cut.withColumn("_own", F.sum("_value").over(Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(before, _same(own, before, [*group, "_range"])).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def medians(df: DataFrame, group: list[str], value: str, parts: int = 256) -> DataFrame:
    """The exact median of each group's values, nulls left out.

    Values of small groups are aggregated at once; where a group is large, values are counted by range, and only the
    middle ranges are put in order.
    """
    have = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"))
    if not _large(have, group):
        return have.groupBy(*group).agg(F.percentile(F.col("v").cast("double"), 0.5).alias("median"))
    runs = have.groupBy(*group, "v").agg(F.count("*").alias("k")).withColumn("_range", _ranges(have, F.col("v"), parts))
    sizes = _offsets(runs.groupBy(*group, "_range").agg(F.sum("k").alias("n")), group)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = reduce(lambda x, y: x | y, ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_in")) for at in (low, high)))
    middle = sizes.where(holds)
    inside = runs.join(middle, _same(runs, middle, [*group, "_range"]))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("k").over(Window.partitionBy(*group, "_range").orderBy("v")))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("v"))).cast("double")
    return inside.groupBy(*group).agg(((at(low) + at(high)) / 2).alias("median"))


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a sorted table, by offset."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(rows: Column, size: int) -> Column:
    return F.ceil(rows / size).cast("long")
