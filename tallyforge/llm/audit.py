"""How the filters of a corpus interact: what each removes, alone, after others and on average over all orders.

Texts are scanned as they lie in Arrow buffers: byte classes by lookup, prefix sums of them at the texts' bounds for
words, capitals, symbols and code points. A word's hash is a difference of prefix sums of powers; sorted per document,
equal neighbours are compared byte by byte, and a document in which two words share a hash is counted by the words
themselves. Every document thus gets a mask of the filters that it fails. A text's copies are counted by its SHA-256
before they are told from the one with the smallest id, so a text that a third of all rows hold is combined before the
shuffle. What is left, a few rows per language and mask, answers every order of the filters.

Defined results: a null text is an empty one; a null lang is the part ''; a null doc_id is never a copy and makes none
of another; rows of one doc_id and text are none of each other's copies; several labels of an id count as one that has
a 1 where any of them has; labels without an id count for none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that are scanned at once; a longer text is scanned in parts that end where words do.
SLICE = 1 << 20
#: The filters as conditions under which a document fails, over the figures of scan() and `copy` (an equal text has a smaller id).
FILTERS = {"A": "words < 200", "B": "100 * distinct_words < 50 * words", "C": "100 * capitals > 3 * chars", "D": "symbols > 0", "E": "copy"}
FIGURES = ["words", "distinct_words", "capitals", "symbols", "chars"]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Scanner:
    """Figures of texts that lie end to end in one array of bytes."""

    def __init__(self, size: int = SLICE) -> None:
        self.size = size
        self.up, self.down = _powers(_ODD, 2 * size), _powers(_INVERSE, 2 * size)
        # A number of its own for each byte, so that no short run of small ones adds up to another.
        x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
        self.numbers = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD)

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word; a word ends at the end of its text."""
        word = ~_BLANK[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        bounds = cuts[:-1][cuts[:-1] < cuts[1:]]
        first[bounds], last[bounds[bounds > 0] - 1] = word[bounds], word[bounds[bounds > 0] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(data) > len(self.up):
            self.up, self.down = _powers(_ODD, len(data)), _powers(_INVERSE, len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.numbers[data] * self.up[: len(data)], dtype=np.uint64)))
        return start, end, (sums[end] - sums[start]) * self.down[start]

    def distinct(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and distinct words of each text, and starts and ends of words that hold every distinct one."""
        start, end, hashed = self._words(data, cuts)
        text = np.searchsorted(cuts, start, "right") - 1
        order = np.lexsort((hashed, text))
        s, e, t = start[order], end[order], text[order]
        same = (hashed[order][1:] == hashed[order][:-1]) & (t[1:] == t[:-1])
        at = np.flatnonzero(same)
        size = e[at] - s[at]
        differ = size != e[at + 1] - s[at + 1]
        size = np.where(differ, 0, size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        unlike = data[np.repeat(s[at], size) + step] != data[np.repeat(s[at + 1], size) + step]
        differ[np.repeat(np.arange(len(at)), size)[unlike]] = True
        new = np.append(True, ~same)[: len(t)]
        counted = np.bincount(t[new], minlength=len(cuts) - 1)
        # Two words that share a hash: such a text's words are compared whole.
        for bad in set(t[at[differ]].tolist()):
            own = t == bad
            counted[bad] = len({data[a:b].tobytes() for a, b in zip(s[own].tolist(), e[own].tolist())})
            new |= own
        return np.bincount(text, minlength=len(cuts) - 1), counted, s[new], e[new]

    def figures(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        words, distinct, _, _ = self.distinct(data, cuts)
        return [words, distinct, *self._classes(data, cuts)]

    @staticmethod
    def _classes(data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        return [np.diff(np.concatenate(([0], np.cumsum(kind[data])))[cuts]) for kind in (_CAPITAL, _SYMBOL, _CHAR)]

    def long(self, data: np.ndarray) -> list[int]:
        """Figures of one long text, in parts that end behind white space."""
        total, seen, at = np.zeros(4, np.int64), set(), 0
        while at < len(data):
            to = at + self.size
            # A word that goes on is taken whole.
            while to < len(data) and not _BLANK[data[to - 1]]:
                blanks = np.flatnonzero(_BLANK[data[to : to + self.size]])
                to = to + int(blanks[0]) + 1 if len(blanks) else to + self.size
            part = data[at:to]
            cuts = np.array([0, len(part)])
            words, _, starts, ends = self.distinct(part, cuts)
            total += [words[0], *(x[0] for x in self._classes(part, cuts))]
            seen.update(part[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
            at = to
        return [int(total[0]), len(seen), *total[1:].tolist()]

    def scan(self, texts: pa.Array) -> list[np.ndarray]:
        """The figures of every text of a binary array, from its buffers."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, i = np.zeros((len(FIGURES), len(texts)), np.int64), 0
        while i < len(texts):
            if offsets[i + 1] - offsets[i] > self.size:
                out[:, i] = self.long(data[offsets[i] : offsets[i + 1]])
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.size, "right")) - 1)
            if offsets[j] > offsets[i]:
                out[:, i:j] = self.figures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
        return list(out)


def scan(docs: DataFrame, keep: list[str], size: int = SLICE) -> DataFrame:
    """The columns `keep` of docs (doc_id, text, ...), the text's SHA-256 as `digest`, and its figures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(size)
        for batch in batches:
            found = scanner.scan(batch.column(len(keep) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *map(pa.array, found)], [*keep, "digest", *FIGURES])

    kept = rows.select(*[F.col(f"`{c}`") for c in keep], "digest").schema
    for name in FIGURES:
        kept = kept.add(name, "long")
    return rows.mapInArrow(run, kept)


def _bits(bits: dict[str, str]):
    """The sum of the bits whose condition holds."""
    return sum((F.when(F.expr(condition), 1 << i).otherwise(0) for i, condition in bits.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, str], size: int = SLICE) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, bit i for the i-th filter."""
    own = {i: c for i, (_, c) in enumerate(filters.items()) if c != "copy"}
    copy = next((1 << i for i, c in enumerate(filters.values()) if c == "copy"), 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    scanned = scan(rows, ["doc_id", "part"], size).select("doc_id", "part", "digest", _bits(own).alias("mask"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = scanned.join(marked, "doc_id", "left").na.fill(False, ["good", "toxic"])
    # Rows of an id count as one, then as many as they are; so the smallest id of a text keeps all of its rows.
    kind = ["part", "digest", "mask", "good", "toxic"]
    ids = each.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    by_text = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = by_text.groupBy("digest").agg(F.min("low").alias("least"))
    first = F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0) + F.col("n_null")
    told = by_text.join(least, "digest").select("part", "mask", "good", "toxic", "n", first.alias("first"))
    sides = F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    counted = told.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).select("part", "good", "toxic", sides.alias("x"))
    return counted.select("part", "good", "toxic", "x.*").where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def steps(filters: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of every order of the filters."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(order), i + 1, bit[order[i]], sum(bit[f] for f in order[:i])) for order in permutations(filters) for i in range(len(order))]


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, size: int = SLICE) -> DataFrame:
    """Per part (lang of docs), order of the filters and step: documents kept, removed, redundant, and so on.

    filters: name and failure condition of each, at most seven; "copy" marks documents whose text a smaller id has.
    """
    every = steps(list(filters))
    at = lambda i: F.element_at(F.lit([x[i] for x in every]), F.col("at"))
    # The list of steps is fixed by the filters: 600 for five of them, whatever the documents are.
    rows = masks(docs, labels, filters, size).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(every)))).alias("at"))
    rows = rows.select("part", "mask", "n", "good", "toxic", at(0).alias("filter_order"), at(1).alias("step"), at(2).alias("bit"), at(3).alias("before"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda n, where: F.sum(F.when(where, F.col(n)).otherwise(0))
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit")
