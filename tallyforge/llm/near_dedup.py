"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles. A sketch has 128 coordinates: in each round every shingle is
hashed to one coordinate with a value, and the lowest (round, value) stays; after as many rounds as coordinates,
round t + i is all for coordinate i, so every coordinate is filled within 2t rounds and agreement concentrates around
the similarity. 32 bands of 4 coordinates propose candidates (at a similarity of 0.75 all bands miss five times in a
million), and links are confirmed on the full sets.

Documents with equal sets are one class, found by a digest, so copies never meet each other. Within a bucket two
members, the centres, are held against all others: first the smallest id; then, where a bucket's members still lie in
several components, the one that shares most of its set. A group of near copies thus costs its size. What is still
open after that is joined exactly: shingles are ordered by how many open documents have them, the rarest first, and two
sets as similar as asked for must meet in the first n - ceil(0.75 n) + 1 shingles of both. Shingles that one document
alone has come first there and need no join, so documents of mostly own shingles drop out, and so do shingles all of
whose documents are in one component already, and documents that the position of a shingle keeps from linking with any
there. A shingle of many documents is dealt over salts. No link between components is lost.

Defined results: no words or null text: an empty set, linked with nothing; fewer than five words: the whole sequence
is one shingle; a null doc_id takes part in no link and is kept; repeated rows are returned each;
an id with several texts links by any of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tallyforge.llm.common import cut, forget, join_checked, slices
from tallyforge.llm.graph import components

COORDINATES, ROWS = 128, 4
#: Documents that a salt of a shingle gets in the exact join, and pairs that a salt of a document gets.
SALTED = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _ODD)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles of a text, as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n) * _ODD + np.uint64(1))
    k, tag = min(n, k), np.uint64(0 if n >= k else n)
    s = np.full(n - k + 1, tag, np.uint64)
    for j in range(k):
        s = mix(s * _ODD + h[j : n - k + 1 + j])
    return np.unique(s)


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a non-empty set; each holds the lowest (round, value) that fell on it."""
    top, low = np.uint64(64 - t.bit_length() + 1), np.uint64(2**56 - 1)
    out, n, at = np.full(t, np.iinfo(np.uint64).max), len(items), 0
    while at < t and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(at, min(t, at + max(1, 640 // n)), dtype=np.uint64)
        v = mix(items[None, :] ^ _SEEDS[rounds][:, None])
        np.minimum.at(out, (v >> top).ravel(), ((rounds[:, None] << np.uint64(56)) | (v & low)).ravel())
        at += len(rounds)
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[i] = (np.uint64(t + i) << np.uint64(56)) | (mix(items ^ _SEEDS[t + i]) & low).min()
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    grid = coordinates.reshape(-1, rows)
    out = np.arange(1, len(grid) + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * _ODD + grid[:, j])
    return out.view(np.int64)


def _long(x: bytes) -> int:
    return int.from_bytes(x, "little", signed=True)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, key_a, key_b, band = [], [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            count.append(len(s))
            key_a.append(_long(digest[:8]))
            key_b.append(_long(digest[8:]))
            band.append(bands(sketch(s)) if len(s) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "n", "key_a", "key_b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo, n in slices(whole.column(1)):
            batch = whole.slice(lo, n)
            found = [shingles(text.as_py()) for text in batch.column(1)]
            keys = [_long(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8]) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["doc_id", "key_a", "items"])


def _with_sets(joined: DataFrame, pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """joined, the pairs with what they have so far, and the sets of one side.

    A document of many pairs, as a bucket's centre, sends its set to as many salts as its pairs need; there are few
    such documents, no more than pairs over SALTED, and the others are joined as they are.
    """
    hot = cut(pairs.groupBy(side).agg(F.count("*").alias("m")).where(F.col("m") > SALTED).select(side, F.expr(f"1 + cast(m div {SALTED} as int)").alias("salts")), "hot")
    other = "b" if side == "a" else "a"
    dealt = join_checked(joined, hot, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    own = join_checked(sets.select(F.col("doc_id").alias(side), F.col("items").alias(f"s{side}")), hot, side, "left")
    spread = own.select(side, f"s{side}", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(spread, [side, "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a cut table whose full sets are similar enough."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    own = join_checked(sets, ids, "doc_id", "left_semi")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = _with_sets(_with_sets(pairs, pairs, "b", own), pairs, "a", own)
    links = cut(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct(), "confirmed")
    forget(ids)
    return links


def _unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets whose members lie in several components, with their `root`.

    The buckets go to the rows, by a counted broadcast, so that no bucket's rows gather in one task.
    """
    rows = rows.drop("root")
    marked = join_checked(rows, roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*rows.columns, F.coalesce("root", "doc_id").alias("root"))
    several = cut(marked.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "several")
    return cut(join_checked(marked, several, "bucket", "left_semi"), "open")


def _prefixes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, u, prefix) of the sets that can link at all, over the documents of rows.

    u: how many of a set's shingles other documents have; prefix: of these the rarest, in which every similar set meets
    it, each with how many of the u come after it, itself included.
    """
    ids = cut(rows.select("doc_id").distinct(), "wanted")
    items = cut(join_checked(sets, ids, "doc_id", "left_semi").select("doc_id", "key_a", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    common = cut(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "common")
    found = join_checked(items, common, "item").groupBy("doc_id", "key_a", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("shared"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    kept = found.where(F.size("shared") >= least).select("doc_id", "n", F.size("shared").alias("u"), F.transform(F.slice("shared", F.lit(1), F.size("shared") - least + 1), lambda x, i: F.struct(x["item"].alias("item"), (F.size("shared") - i).alias("after"))).alias("prefix"))
    out = cut(kept, "prefixes")
    forget(ids, items, common)
    return out


def _able(each: DataFrame, percent: int) -> DataFrame:
    """The rows (item, doc_id, root, n, after) that can meet a row of another component at their item.

    What comes after a meeting bounds the size of the other set (its reach), for both sides. So a row stays where its
    reach takes in the smallest set of the item's other components, and its size lies within their furthest reach:
    extremes by item and component tell, and the many documents of a common passage drop out before any meet.
    """
    reach = F.expr(f"{100 + percent} * after div {percent} - n")
    own = cut(each.groupBy("item", "root").agg(F.min("n").alias("least"), F.max(reach).alias("reach")), "extremes")
    first = own.groupBy("item").agg(F.min(F.struct("least", "root")).alias("small"), F.max(F.struct("reach", "root")).alias("far"))
    others = lambda what, of: F.when(F.col("root") != F.col(f"{of}.root"), F.col(what))
    # Of the component that holds an extreme, the best of all others counts; an item of one component has none.
    bounds = own.join(first, "item").groupBy("item").agg(F.first("small").alias("small"), F.first("far").alias("far"), F.min(others("least", "small")).alias("small2"), F.max(others("reach", "far")).alias("far2")).where("small2 is not null")
    beyond = lambda of, what: F.when(F.col("root") == F.col(f"{of}.root"), F.col(f"{of}2")).otherwise(F.col(f"{of}.{what}"))
    met = join_checked(each, cut(bounds, "bounds"), "item").where((reach >= beyond("small", "least")) & (F.col("n") <= beyond("far", "reach")))
    return cut(met.select(*each.columns), "able")


def _meeting(rows: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents of rows, in different components, that meet in both prefixes.

    Where two sets first meet, they share no more than comes after that in either; so only a meeting after which
    enough is left counts.
    """
    still = cut(rows.select("doc_id", "root").distinct(), "still")
    each = cut(join_checked(prefixes, still, "doc_id").select("doc_id", "root", "n", F.explode("prefix").alias("p")).select("doc_id", "root", "n", "p.item", "p.after"), "prefix")
    each = _able(each, percent)
    across = each.groupBy("item").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    each = cut(join_checked(each, cut(across.select("item", "m"), "across"), "item"), "prefix")
    salts = F.expr(f"1 + cast(m div {SALTED} as int)")
    left = each.select("item", F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("after").alias("ua"))
    right = each.select("item", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("after").alias("ub"))
    return left.join(right, ["item", "salt"]).where(f"a < b and ra <> rb and {100 + percent} * least(ua, ub) >= {percent} * (na + nb)").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; linked at 100 * shared >= percent * union."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = cut(texts.mapInArrow(_sketched, "doc_id long, n long, key_a long, key_b long, bands array<long>"), "sketches")
    ids = seen.where("n > 0 and doc_id is not null").select("doc_id", "n", "key_a", "key_b", "bands")
    classes = cut(ids.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")), "classes")
    member = ids.join(classes, ["key_a", "key_b"]).select("doc_id", "rep")
    # An id with several texts joins the classes of all of them.
    many = cut(member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"), "many")
    links = cut(join_checked(member, many, "doc_id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "links")
    again = not ids.groupBy("doc_id", "key_a").agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    once = lambda rows: rows.dropDuplicates(["doc_id", "key_a"]) if again else rows

    reps = once(ids.join(classes.select(F.col("rep").alias("doc_id"), "key_a", "key_b"), ["doc_id", "key_a", "key_b"], "left_semi"))
    rows = reps.select("doc_id", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "n")).alias("first")).where("m > 1")
    in_buckets = cut(rows.join(shared, "bucket").select("bucket", "doc_id", "n", F.col("first.doc_id").alias("first"), F.col("first.n").alias("nf"), "m"), "buckets")
    wanted = cut(in_buckets.select("doc_id").distinct(), "wanted")
    sets = cut(once(join_checked(texts, wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, key_a long, items array<long>")), "sets")

    similar = f"100 * least(n, nf) >= {percent} * greatest(n, nf)"
    tried = cut(in_buckets.where("doc_id > first").where(similar).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = cut(links.union(_confirmed(tried, sets, percent)), "links")
    roots = components(links)
    left = _unsettled(in_buckets.where("m > 2").select("bucket", "doc_id", "n"), roots)
    if not left.isEmpty():
        prefixes = _prefixes(left, sets, percent)
        left = cut(join_checked(left, prefixes.select("doc_id", "n", "u"), ["doc_id", "n"]), "open")
        best = left.groupBy("bucket").agg(F.max(F.struct(F.col("u") / F.col("n"), -F.col("doc_id"), "n", "root", "u")).alias("top"))
        centre = cut(best.select("bucket", (-F.col("top.col2")).alias("c"), F.col("top.n").alias("nf"), F.col("top.root").alias("rc"), F.col("top.u").alias("uc")), "centres")
        could = f"root <> rc and {100 + percent} * least(u, uc) >= {percent} * (n + nf)"
        held = join_checked(left, centre, "bucket").where(could).select(F.least("c", "doc_id").alias("a"), F.greatest("c", "doc_id").alias("b")).distinct()
        fresh = cut(held.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = cut(links.union(_confirmed(fresh, sets, percent)), "links")
        roots, tried = components(links), tried.union(fresh)
        left = _unsettled(left, roots)
    if not left.isEmpty():
        fresh = cut(_meeting(left, prefixes, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        roots = components(cut(links.union(_confirmed(fresh, sets, percent)), "links"))
    forget(in_buckets, sets)
    own = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = seen.join(own, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
