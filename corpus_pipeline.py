"""A corpus run: each stage reads what the stage before it kept, written as Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup, mixing, near_dedup, packing, quality, queries
from tallyforge.llm.common import cut, forget, join_checked, table


# Every stage takes any columns beside those of documents, whatever their names, and returns an empty table for one.
# A null text counts as an empty one; what else a stage does with it, and with nulls and repeats, its docstring says.


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on labelled documents, rejects.

    Rows are judged one by one by their text alone, so repeated rows and rows without an id stay or go by it.
    """
    scored = quality.score(docs, queries.quality_model(spark, sf_dir))
    return scored.where(F.col("_quality") >= quality.ACCEPT).drop("_quality")


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least ten of the documents share; n_chars follows the text.

    Repeated rows count as one document and all stay; rows without an id count as none and lose common lines too; a
    null text becomes the empty one.
    """
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1).drop("_n_lines", "_n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, as one row.

    Rows of one doc_id are one document, of which the row with the smallest text digest stays; so are rows without
    doc_id whose texts are equal.
    """
    gone = cut(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return one_row_each(join_checked(docs, gone, "doc_id", "left_anti"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row per doc_id, and per text where doc_id is null; only rows that repeat are grouped whole, by partial minima."""
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), digest))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    if again.isEmpty():
        return docs
    order = F.struct(F.sha2(F.col("row.text").cast("binary"), 256), F.sha2(F.to_json("row").cast("binary"), 256))
    first = join_checked(rows, again, "key", "left_semi").groupBy("key").agg(F.min_by("row", order).alias("row"))
    return join_checked(rows, again, "key", "left_anti").select("row.*").union(first.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of each leaf's share of three quarters of the tokens; a document on the border stays whole.

    A document without text has no tokens and isn't chosen; without a language or source it belongs to the leaf of that.
    """
    return queries.mixed(docs, epochs=1).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents' tokens into windows of 4096; a document without text is its end token alone."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("quality classifier", classify), ("line dedup", clean_lines), ("near dedup", one_of_each), ("mixing", mix), ("packing", pack)]

#: Scoring, sketching and packing are outside SQL; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's output is removed once the next one is written, the last when Spark ends."""
    source = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if docs is not source:
            forget(docs)
        docs = after
    return docs
