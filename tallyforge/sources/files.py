"""Declared-schema file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.scalar import csv_field, decimal_value, digits_value
from tallyforge.operators.matching import by_priority
from tallyforge.sources.scratch import scratch as scratch


def present(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def constant_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table that the program itself declares, as the parties and districts of a contest; a few rows, in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def json_rows(spark: SparkSession, path: str, schema: str, arrays: bool = True, optional: bool = False) -> DataFrame:
    """Rows of files that hold one JSON array each, or one JSON document a line; none for an optional path that isn't there."""
    if optional and not present(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", arrays).json(path)


def array_literal(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of the JSON array that a source file exports under a name.

    The JSON reader itself finds the bracket that closes the array, past brackets in texts, and leaves the rest.
    """
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\bconst\s+{name}\b[^=]*=\s*(\[.*)", 1)
    return text.select(F.explode(F.from_json(body, f"array<struct<{schema}>>")).alias("x")).select("x.*")


def plain_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Comma-split text without quoting: trimmed fields, missing ones empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).option("header", True).option("quote", "").option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), '"', "")).alias(c) for c in columns])


def quoted_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


RESULT_COLUMNS = ["year", "ac_number", "constituency_name", "position", "candidate", "sex", "age", "category", "party", "votes_general", "votes_postal", "votes", "vote_share_pct", "total_electors", "turnout_pct", "margin"]


def wide_results(df: DataFrame) -> DataFrame:
    """Result rows with numbers read as numbers, bad ones 0; rows without a contest number are dropped."""
    whole = ["year", "ac_number", "position", "votes_general", "votes_postal", "votes", "total_electors", "margin"]
    out = df.select(*[(digits_value(c) if c in whole else decimal_value(c) if c.endswith("_pct") else F.trim(F.col(c))).alias(c) for c in df.columns])
    return out.where("ac_number > 0")


def chosen_history(wide: DataFrame, plain: DataFrame, winners: DataFrame, last_year: int) -> DataFrame:
    """Per year the first of three sources that has rows; the winners' file only for its year."""
    return by_priority([wide, plain, winners.where(F.col("year") == last_year)], "year")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("line"))


def envelope(df: DataFrame) -> DataFrame:
    """One JSON document per row, and how many rows there are beside each: what a listing endpoint sends."""
    total = df.agg(F.count("*").alias("total"))
    return df.select(F.to_json(F.struct("*")).alias("data")).join(F.broadcast(total))
