"""Tables laid out for what is read of them: by key, by page of an order, behind a row policy."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _note(spark: SparkSession, path: str, note: dict | None = None) -> dict:
    """The layout of a table, kept beside it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_layout.json")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if note is not None:
        out = files.create(at, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        return note
    stream = files.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of a table's folders name=number."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return sorted(int(n[len(name) + 1 :]) for n in found if n.startswith(f"{name}="))


def write(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """One sorted file per bucket of the key's hash, with a bloom filter of its keys: one key is in one file."""
    spread = df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", key)
    spread.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("_bucket").parquet(path)
    _note(df.sparkSession, path, {"buckets": buckets, "held": _parts(df.sparkSession, path, "_bucket"), "schema": json.loads(df.schema.json())})


def read(spark: SparkSession, path: str, key: str, wanted: list) -> DataFrame:
    """The rows of a few keys; only the files of their buckets are opened, and there only row groups that may hold them."""
    note = _note(spark, path)
    schema = StructType.fromJson(note["schema"])
    few = spark.createDataFrame([(k,) for k in wanted], StructType().add(key, schema[key].dataType))
    buckets = [r[0] for r in few.select(_bucket(key, note["buckets"])).distinct().collect()]
    folders = [f"{path}/_bucket={b}" for b in sorted(set(buckets) & set(note["held"]))]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders).where(F.col(key).isin(wanted))


def write_sorted(df: DataFrame, path: str, order: list[Column], ranges: int = 256) -> None:
    """Ranges of an order, each sorted in a folder of its own, and how many rows lie before each."""
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.partitionBy("_part").parquet(path)
    # As many rows as ranges.
    written = df.sparkSession.read.schema(StructType([*df.schema.fields]).add("_part", "integer")).parquet(path)
    sizes = sorted((r["_part"], r["n"]) for r in written.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for _, n in sizes:
        before.append(total)
        total += n
    _note(df.sparkSession, path, {"parts": [p for p, _ in sizes], "before": before, "rows": total, "schema": json.loads(df.schema.json())})


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """One page of a sorted table, from the ranges that hold it: as quick for the last page as for the first."""
    note = _note(spark, path)
    schema = StructType.fromJson(note["schema"])
    low, high = (number - 1) * size, min(number * size, note["rows"])
    if low >= high:
        return spark.createDataFrame([], schema)
    first, last = bisect_right(note["before"], low) - 1, bisect_right(note["before"], high - 1) - 1
    rows = spark.read.schema(StructType([*schema.fields]).add("_at", "long"))
    held = [rows.parquet(f"{path}/_part={note['parts'][i]}").withColumn("_place", F.col("_at") + note["before"][i]) for i in range(first, last + 1)]
    return reduce(DataFrame.union, held).where((F.col("_place") >= low) & (F.col("_place") < high)).orderBy("_place").select(*schema.names)


def publish(df: DataFrame, name: str, policy: Column) -> None:
    """A view that holds the rows that a policy lets through, under the name that readers use; the table itself has none."""
    df.where(F.coalesce(policy, F.lit(False))).createOrReplaceTempView(name)
