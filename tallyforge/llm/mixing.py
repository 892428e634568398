"""Mixing sources to target weights over a domain-language-source tree, in DataFrame operations only.

The token budget flows down the tree. At every node it is shared among the children by weight; a child that can't
use its share (its tokens times the epochs allowed) gives the rest back to its siblings, in proportion to their
weights, and only when the whole sibling group is short does the rest reach the next ancestor's children. Shares are
whole tokens: remainders of the division go to the first children by name. Each leaf then takes the prefix of its
seeded order (a digest of seed, epoch and id) that holds its share; the document on the border gives its first tokens.

Scale: weights and shares are tables of one row per node. Prefixes are found without sorting a leaf: tokens are summed
by the first digits of the digest, whole digit groups lie inside or outside the share, and only the group on the
border is opened, by three more digits and then by keys, so a leaf with a third of all rows is never in one task and
the documents themselves aren't shuffled.

Defined results: null lang or source is the value '?'; null or empty text has no tokens and is never selected; weights
missing from the tables are 1; a weight of 0 selects nothing; repeated ids stand in one place of the order and, on the
border, split what is left evenly (rounded down); rows without doc_id are such repeats; an empty table gives no rows;
other columns pass through, but those named as the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, join_checked

LEAF = ["_domain", "_lang", "_source"]
#: Characters of the key (three digits of the epoch, then the digest) that each level of the prefix search opens.
PREFIXES = (5, 8, 35)


def weight_of(key: Column, weights: dict[str, int], default: int = 1) -> Column:
    """A weight per name, as a CASE over the given table."""
    out = F.lit(default)
    for name, weight in sorted(weights.items()):
        out = F.when(key == name, weight).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`share` per child of each parent, from its `budget` (at most the sum of `cap`), `cap` and `weight`.

    Children in the order of cap / weight: one is filled when its cap is no more than its part of what the children
    before it left; the first that isn't, and all after it, split the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    n = nodes.where("weight > 0").withColumn("_rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(after))
    n = n.withColumn("_open", F.col("cap") * F.col("_w") > F.col("_rest") * F.col("weight"))
    # From the first open child on, all are open; what was left there is what they split.
    n = n.withColumn("_first", F.min(F.when(F.col("_open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col(name).alias("name"), F.col("_rest").alias("rest"), F.col("_w").alias("w")))).over(every))
    n = n.withColumn("_part", F.when(F.col("_open"), F.expr("_first.rest * weight div _first.w")))
    spare = F.col("_first.rest") - F.sum(F.coalesce("_part", F.lit(0))).over(every)
    place = F.sum(F.when(F.col("_open"), 1).otherwise(0)).over(Window.partitionBy(*parent).orderBy(F.col(name)).rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("share", F.when(~F.col("_open"), F.col("cap")).otherwise(F.least(F.col("_part") + (place <= spare).cast("long"), F.col("cap")))).drop("_rest", "_w", "_open", "_first", "_part", "budget")


def leaf_shares(leaves: DataFrame, budget: Column, domain_weights: dict[str, int], lang_weights: dict[str, int], source_weights: dict[str, int], epochs: int) -> DataFrame:
    """`share` in tokens for each leaf of `leaves` (the leaf's columns and `tokens`); budget is over the sum of tokens."""
    caps = leaves.select(*LEAF, (F.col("tokens") * epochs).alias("cap"), weight_of(F.col("_source"), source_weights).alias("weight"), weight_of(F.col("_lang"), lang_weights).alias("w_lang"), weight_of(F.col("_domain"), domain_weights).alias("w_domain"))
    # What lies under a weight of 0 can't be used.
    caps = caps.where("weight > 0 and w_lang > 0 and w_domain > 0")
    langs = caps.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap"), F.min("w_lang").alias("weight"), F.min("w_domain").alias("w_domain"))
    domains = langs.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.min("w_domain").alias("weight"))
    one = F.lit(1).alias("_root")
    root = leaves.agg(F.sum("tokens").alias("tokens")).select(one, budget.cast("long").alias("budget")).join(caps.agg(F.sum("cap").alias("room")).select(one, "room"), "_root").select("_root", F.least("budget", "room").alias("budget"))
    by_domain = share_out(domains.withColumn("_root", F.lit(1)).join(root, "_root"), ["_root"], "_domain").select("_domain", F.col("share").alias("budget"))
    by_lang = share_out(langs.join(by_domain, "_domain"), ["_domain"], "_lang").select("_domain", "_lang", F.col("share").alias("budget"))
    return share_out(caps.join(by_lang, ["_domain", "_lang"]), ["_domain", "_lang"], "_source").select(*LEAF, "share")


def prefix_ends(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Per leaf, the key on which its share ends (`_end`), the tokens left for that key and its rows (`_left`, `_n`)."""
    found, level = shares.select(*LEAF, F.lit("").alias("_prefix"), F.col("share").alias("_left")), None
    for length in PREFIXES:
        before = level or 0
        opened = join_checked(rows.withColumn("_prefix", F.substring("_key", 1, before)), found, [*LEAF, "_prefix"])
        sums = opened.groupBy(*LEAF, "_left", F.substring("_key", 1, length).alias("_group")).agg(F.sum("_tokens").alias("_t"), F.count("*").alias("_n"))
        run = sums.withColumn("_run", F.sum("_t").over(Window.partitionBy(*LEAF).orderBy("_group")))
        on = F.min(F.struct("_group", (F.col("_left") - F.col("_run") + F.col("_t")).alias("left"), "_n")).alias("on")
        found = cut(run.where("_run >= _left").groupBy(*LEAF).agg(on).select(*LEAF, F.col("on._group").alias("_prefix"), F.col("on.left").alias("_left"), F.col("on._n").alias("_n")), "ends")
        level = length
        if length != PREFIXES[-1]:
            found = found.drop("_n")
    return found.withColumnRenamed("_prefix", "_end")


def mix(
    docs: DataFrame,
    domain: Column,
    tokens: Column,
    budget: Column,
    domain_weights: dict[str, int],
    lang_weights: dict[str, int],
    source_weights: dict[str, int] | None = None,
    epochs: int = 1,
    seed: str = "0",
) -> DataFrame:
    """The selected (document, epoch) rows: all columns of docs, and _domain, _lang, _source, _epoch, _tokens, _take.

    `budget` is an expression over `tokens` (all tokens there are), such as F.expr("tokens div 2").
    """
    # The rows travel as one struct, so no column of theirs can meet one made here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(domain, F.lit("?")).alias("_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("_source"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("_tokens"),
        F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("_epoch"),
    ).where("_tokens > 0")
    name = F.concat_ws(":", F.lit(seed), F.col("_epoch").cast("string"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_key", F.concat(F.lpad(F.col("_epoch").cast("string"), 3, "0"), F.md5(name.cast("binary"))))
    slim = cut(rows.select(*LEAF, "_epoch", "_key", "_tokens"), "order")
    leaves = cut(slim.where("_epoch = 1").groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens")), "leaves")
    shares = cut(leaf_shares(leaves, budget, domain_weights, lang_weights, source_weights or {}, epochs).where("share > 0"), "shares")
    ends = prefix_ends(slim, shares)
    taken = join_checked(rows, ends, LEAF).where("_key <= _end")
    take = F.when(F.col("_key") < F.col("_end"), F.col("_tokens")).otherwise(F.least("_tokens", F.expr("_left div _n")))
    out = taken.withColumn("_take", take).where("_take > 0")
    made = [*LEAF, "_epoch", "_tokens", "_take"]
    return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in made], *made)
