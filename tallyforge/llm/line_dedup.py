"""Dropping lines that many documents share.

A document's different lines are exploded as hashes of their normalised form (white space stripped at both ends, A-Z
lower-cased) and counted, a hot line by partial sums. Only lines that come often enough go on, to be told by their full
digests and counted by distinct documents. As long as the common lines are as few as a counted broadcast allows, they go
to the texts, and every task drops them in place: no text is shuffled. Beyond that the positions of common lines are
gathered per document and joined to its text.

Defined results: a null or empty text is one empty line; lines whose key is shorter than `min_chars` stay; rows
without doc_id count as no document but lose common lines like any other; repeated rows count as one document and
each is returned; an empty table gives no rows; other columns pass through, but those named as
the new ones are replaced.
"""

from __future__ import annotations

import string
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, forget, join_checked, map_text

#: Stripped at both ends of a line: the space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Common lines, as digests of 16 bytes, that are sent to every task; beyond so many they are joined.
COMMON = 100_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(docs: DataFrame, text: Column, min_chars: int) -> DataFrame:
    """(_doc, _key): the different keys of each row's lines that are long enough."""
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), line_key), lambda k: F.length(k) >= min_chars))
    return docs.select(F.col("doc_id").alias("_doc"), F.explode(keys).alias("_key"))


def common_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(_digest) of the keys that at least min_docs documents hold, as a cut table."""
    lines = _lines(docs, F.coalesce(F.col("text").cast("string"), F.lit("")), min_chars)
    # Rows of a hash are no fewer than the documents of any of its keys.
    often = cut(lines.groupBy(F.xxhash64("_key").alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("_h"), "often")
    kept = join_checked(lines.select("_doc", F.xxhash64("_key").alias("_h"), F.md5(F.col("_key").cast("binary")).alias("_digest")), often, "_h")
    common = cut(kept.groupBy("_digest").agg(F.count_distinct("_doc").alias("n")).where(F.col("n") >= min_docs).select("_digest"), "common")
    forget(often)
    return common


def _dropped_in_place(docs: DataFrame, digests: set[bytes]) -> DataFrame:
    """docs with `text` cleaned and `_n_lines`, `_n_dropped`; digests: MD5 of the common keys."""
    shared, blanks = docs.sparkSession.sparkContext.broadcast(digests), BLANKS.encode()

    def per_texts(texts: list[str | None]):
        gone, kept, lines, dropped = shared.value, [], [], []
        for text in texts:
            every = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            left = [x for x in every if not (key := x.strip(blanks).lower()) or md5(key, usedforsecurity=False).digest() not in gone]
            kept.append((text or "") if len(left) == len(every) else b"\n".join(left).decode("utf-8", "surrogatepass"))
            lines.append(len(every))
            dropped.append(len(every) - len(left))
        return kept, lines, dropped

    # The rows travel as one struct, so no column of theirs can meet one made here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    return map_text(own, "kept string, n_lines long, n_dropped long", per_texts)


def _dropped_by_join(docs: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """The same for any number of common keys."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    keyed = lines.select("_doc", "_text", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    hits = keyed.select("_doc", "_text", "_pos", F.md5(F.col("_key").cast("binary")).alias("_digest")).join(common.hint("merge"), "_digest").groupBy("_doc", "_text").agg(F.collect_set("_pos").alias("_drop"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text.alias("whole")).withColumn("key", F.xxhash64("whole"))
    joined = own.join(hits, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_text")), "left").withColumn("lines", F.split("whole", "\n", -1))
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_drop")
    cleaned = F.when(F.col("_drop").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(rest, lambda p: F.get("lines", p)), "\n"))
    return joined.select("row", cleaned.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All columns of docs with `text` reduced to its kept lines, and `_n_lines`, `_n_dropped` beside them."""
    common = common_lines(docs, min_docs, min_chars)
    few = common.limit(COMMON + 1).collect()
    if len(few) <= COMMON:
        made = _dropped_in_place(docs, {bytes.fromhex(r["_digest"]) for r in few})
    else:
        made = _dropped_by_join(docs, common, min_chars)
    return made.select(*[(F.col("kept") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_dropped")], F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))
