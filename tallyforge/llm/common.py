"""Helpers the corpus operators share: table access, folds, shared-folder cut points, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checked table may be broadcast (a few MB for the narrow tables used here).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo folds; 0 marks the held-out rows. A null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs one reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the files behind frames made by cut() that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting small (a cut() table) only when it is counted to hold at most `rows` rows.

    Beyond that it is a sort-merge join, whose hot partitions adaptive execution splits.
    """
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def slices(texts, rows: int = 1000, size: int = 1 << 22, sizes=None) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of an Arrow array of texts: at most `rows` of them and about `size` bytes, one at least.

    sizes: an array of how many bytes each text counts for, its own where that is null.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(texts):
        return
    own = pa.nulls(len(texts), pa.int64()) if pa.types.is_null(texts.type) else pc.cast(pc.binary_length(texts), pa.int64())
    weight = own if sizes is None else pc.coalesce(pc.cast(sizes, pa.int64()), own)
    ends = pc.cumulative_sum(pc.fill_null(weight, 0)).to_pylist()
    at, before = 0, 0
    while at < len(texts):
        to = at + 1
        while to < len(texts) and to - at < rows and ends[to] - before <= size:
            to += 1
        yield at, to - at
        at, before = to, ends[to - 1]


def map_text(docs: DataFrame, columns: str, per_texts, column: str = "text", rows: int = 1000, size: str | None = None) -> DataFrame:
    """All columns of docs and new ones: per_texts turns a list of the column's texts into a list of each new column.

    The texts come in slices of at most `rows` and a few MB, by their own length or the column `size`, if docs has that.
    columns: name and type of the new ones, as in "a double, b long"; same-named columns of docs are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(columns)
    docs = docs.drop(*new.names)
    arrow = to_arrow_schema(new)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            sizes = batch.column(batch.schema.get_field_index(size)) if size in batch.schema.names else None
            for lo, n in slices(texts, rows, sizes=sizes):
                own = batch.slice(lo, n)
                made = per_texts(texts.slice(lo, n).to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, f.type) for x, f in zip(made, arrow))], [*batch.schema.names, *arrow.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new.fields]))
