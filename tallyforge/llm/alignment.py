"""How the tokens of two tokenizers lie over the same text: groups between common cuts, links, and links' counts.

A text, with the space in front that both tokenizers see, is encoded by both. Cumulative token lengths give the ends of
tokens in bytes; ends that both share cut the text into groups, and every pair of tokens whose byte ranges overlap is a
link. How often a pair of ids is linked is counted over all texts: per document first, then per task's partition under
a salt, then per pair. The counts go back to the documents' pairs: those of the commonest pairs by a broadcast of bounded
size, the others by a join, so a pair that every document holds gathers nowhere.

Texts are cut into words that start with a space after a character that is no white space and before any other. Neither
tokenizer has tokens across such a place (the second one's pieces are looked through for it), so it is a common cut, and
the words' tokens, groups and links are the whole text's. A task aligns the words that it doesn't remember end to end,
and lays the texts out of them; long texts are taken in pieces, so memory is bounded by a piece, by the words remembered
and by a document's distinct pairs.

Defined results: null and empty texts, and texts whose tokens don't spell the text in either tokenizer, have no tokens:
zeros and an empty digest. Rows are told apart by themselves, so a repeated row, or a null or repeated doc_id, is a row
like any other and counts again. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: Characters of a piece, about; texts are gathered to about as many before they are aligned.
PIECE = 1 << 20
#: Words whose alignment a task remembers; texts that are laid out at once.
KNOWN, TEXTS = 1 << 18, 4096
#: Salts under which a pair is counted before it is counted whole; rows of counts that are broadcast.
SALTS, COMMON_PAIRS = 16, 200_000
_ID_BITS = 31

ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_CUT = re.compile(r"(?s)(?<=\S) (?=.)")


class BytePairs:
    """The first tokenizer: byte-level BPE, ids of texts and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Bytes whose character prints stand for themselves; the others, in order, for the characters from 256 on.
        shown = set(pre_tokenizers.ByteLevel.alphabet())
        hidden = [b for b in range(256) if chr(b) not in shown]
        own = {chr(b): b for b in range(256) if chr(b) in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        tokens = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        self.bytes = _by_id([(i, bytes(own[c] for c in t)) for t, i in tokens if all(c in own for c in t)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """The second tokenizer: pieces with byte fallback, which puts the space in front of a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.tokenizer.get_piece_size())
        pieces = [self.tokenizer.id_to_piece(i) for i in ids]
        self.bytes = _by_id([(i, bytes([int(p[3:-1], 16)]) if self.tokenizer.is_byte(i) else p.replace("\u2581", " ").encode()) for i, p in zip(ids, pieces)])
        #: Whether a text may be cut before any space that follows a character other than white space.
        self.cuts = not any(re.search("[^\u2581]\u2581", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode([t[1:] for t in texts], num_threads=1)


def _by_id(tokens: list[tuple[int, bytes]]) -> list[bytes]:
    out = [b""] * (max(i for i, _ in tokens) + 1)
    for i, b in tokens:
        out[i] = b
    return out


def pieces(text: str, cuts: bool, size: int = PIECE) -> Iterator[str]:
    """The text behind its space, in pieces of about `size` characters that start with a space."""
    whole, at = " " + text, 0
    while cuts and len(whole) - at > size and (m := _CUT.search(whole, at + size)):
        yield whole[at : m.start()]
        at = m.start()
    yield whole[at:]


class Aligner:
    """Aligns the words of texts end to end, and lays texts out of the words that it remembers."""

    def __init__(self, path_a: str, path_b: str, piece: int = PIECE) -> None:
        self.a, self.b, self.piece = BytePairs(path_a), Pieces(path_b), piece
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # An id as it is written inside a group, and as the last of its side.
        self.shown = [[np.array([f"{i}{end}" for i in range(len(t.bytes))], object) for end in ends] for t, ends in ((self.a, ",|"), (self.b, ",;"))]
        self.forget()

    def forget(self) -> None:
        #: The place of each word, and by place: tokens of both sides, groups and links; groups written out; links laid end to end.
        self.place: dict[str, int] = {}
        self.figures, self.written = np.zeros((4, 0), np.int64), []
        self.linked, self.start = np.empty(0, np.int64), np.zeros(1, np.int64)

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """The ids of both sides of each text, or None where they don't spell it."""
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            raw = text.encode()
            yield (a, b) if b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b.bytes.__getitem__, b)) else None

    def aligned(self, ids: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of texts laid end to end, up to their bounds in bytes: figures of each, its links as pairs of ids, groups written out."""
        sizes = [self.sizes[side][ids[side]] for side in (0, 1)]
        ends = [np.cumsum(s) for s in sizes]
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        # A token of the first side meets those of the second from the one its first byte lies in to that of its last.
        low, high = np.searchsorted(ends[1], ends[0] - sizes[0], "right"), np.searchsorted(ends[1], ends[0])
        times = high - low + 1
        at_a = np.repeat(np.arange(len(times)), times)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(times) - times - low, times)
        pair = (ids[0][at_a] << _ID_BITS) | ids[1][at_b]
        # Groups in order, the first side's tokens of each before the second's.
        out = np.empty(len(ids[0]) + len(ids[1]), object)
        before_b, before_a = np.searchsorted(group[1], group[0]), np.searchsorted(group[0], group[1], "right")
        for side, place in ((0, np.arange(len(ids[0])) + before_b), (1, np.arange(len(ids[1])) + before_a)):
            last = np.append(group[side][1:] != group[side][:-1], True)
            out[place] = np.where(last, self.shown[side][1][ids[side]], self.shown[side][0][ids[side]])
        upto = [np.concatenate(([0], np.searchsorted(e, bounds) + 1)) for e in (*ends, common)]
        links = np.concatenate(([0], np.cumsum(times)))[upto[0]]
        tokens = (upto[0] + upto[1]).tolist()
        text = ["".join(out[lo:hi].tolist()) for lo, hi in zip(tokens, tokens[1:])]
        return np.array([np.diff(x) for x in (*upto, links)]), links, pair, text

    def learn(self, words: set[str]) -> None:
        """Aligns words that aren't remembered yet; those that a tokenizer doesn't spell get the place -1."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > KNOWN:
            self.forget()
            new = list(words)
        if not new:
            return
        # Words end before a space that starts the next one, so that their tokens stay their own side by side.
        open_end = [w for w in new if w[-1:].isspace()]
        closed = [w for w in new if not w[-1:].isspace()]
        both = next(self.encoded([" " + " ".join(closed)])) if closed and self.b.cuts else None
        if both is not None:
            self._keep(closed, [np.array(x, np.int64) for x in both])
            closed = []
        single = closed + open_end
        each = list(self.encoded([" " + w for w in single]))
        self.place.update((w, -1) for w, x in zip(single, each) if x is None)
        good = [(w, x) for w, x in zip(single, each) if x is not None]
        if good:
            self._keep([w for w, _ in good], [np.concatenate([np.array(x[side], np.int64) for _, x in good]) for side in (0, 1)])

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        figures, links, pair, written = self.aligned(ids, np.cumsum([len(w.encode()) + 1 for w in words]))
        self.place.update(zip(words, range(len(self.written), len(self.written) + len(words))))
        self.start = np.concatenate((self.start, links[1:] + self.start[-1]))
        self.figures, self.linked = np.concatenate((self.figures, figures), axis=1), np.concatenate((self.linked, pair))
        self.written += written

    def documents(self, texts: Iterator[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text, many short ones laid out at once."""
        waiting, size = [], 0
        for text in texts:
            if text and len(text) > self.piece:
                yield from self._short(waiting)
                waiting, size = [], 0
                yield self._long(text)
                continue
            waiting.append(text or "")
            size += len(text or "")
            if size > self.piece or len(waiting) >= TEXTS:
                yield from self._short(waiting)
                waiting, size = [], 0
        yield from self._short(waiting)

    def _words(self, text: str) -> list[str]:
        """The words of a text, each without the space that it starts with."""
        return _CUT.split(text) if self.b.cuts and text else [text] if text else []

    def _laid(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Of texts as words: figures, groups written out, distinct pairs and how often each occurs; None if not spelled."""
        self.learn(set().union(*texts))
        place = np.fromiter((self.place[w] for own in texts for w in own), np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        bad = np.zeros(len(texts), bool)
        bad[text[place < 0]] = True
        times = np.where(place < 0, 0, self.start[place + 1] - self.start[place])
        at = np.repeat(self.start[place] - np.cumsum(times) + times, times) + np.arange(times.sum())
        # Pairs of one text lie side by side: its number stands above their bits.
        high = int(self.linked.max()).bit_length() if len(self.linked) else 0
        keys, counts = np.unique((np.repeat(text, times) << high) | self.linked[at], return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(texts) + 1) << high)
        pairs = keys & ((1 << high) - 1)
        sums = np.concatenate((np.zeros((4, 1), np.int64), np.cumsum(self.figures[:, place], axis=1)), axis=1)
        figures = np.diff(sums[:, bounds], axis=1)
        places = place.tolist()
        for i in range(len(texts)):
            own = slice(edges[i], edges[i + 1])
            # Every word's groups end with a separator; the text's last has none.
            yield None if bad[i] else (figures[:, i], "".join(map(self.written.__getitem__, places[bounds[i] : bounds[i + 1]]))[:-1], pairs[own], counts[own])

    def _short(self, texts: list[str]) -> Iterator[tuple]:
        for text, made in zip(texts, self._laid([self._words(t) for t in texts])):
            yield (*made[0].tolist(), hashlib.sha256(made[1].encode()).hexdigest(), *made[2:]) if text and made else _NOTHING

    def _long(self, text: str) -> tuple:
        figures, digest, more = np.zeros(4, np.int64), hashlib.sha256(), b""
        pairs = times = np.empty(0, np.int64)
        for part in pieces(text, self.b.cuts, self.piece):
            made = next(self._laid([self._words(part[1:])]))
            if made is None:
                return _NOTHING
            figures += made[0]
            digest.update(more + made[1].encode())
            more = b";"
            pairs, where = np.unique(np.concatenate((pairs, made[2])), return_inverse=True)
            times = np.bincount(where, np.concatenate((times, made[3])).astype(float)).astype(np.int64)
        return (*figures.tolist(), digest.hexdigest(), pairs, times)


_NOTHING = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))


def links(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE) -> DataFrame:
    """Per row of docs (doc_id, text): tokens, groups and links, and the distinct linked pairs with how often each occurs.

    A pair is the first tokenizer's id times 2^31 plus the second's.
    """
    figures = ("doc_id", "n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b, piece)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            *columns, digests, pairs, times = zip(*rows)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in pairs]))).astype(np.int32)
            linked = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, times)], ["pair", "n"])
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), linked)], [*figures, "groups_sha256", "linked"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, made in zip(batch.column(0), aligner.documents(x.as_py() for x in batch.column(1))):
                rows.append((doc_id.as_py(), *made))
                held += len(made[-1])
                if held > 4 * PIECE:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{ROW}, linked array<struct<pair:bigint,n:bigint>>")


def _each(linked: DataFrame, *columns: str) -> DataFrame:
    return linked.select(*columns, F.explode("linked").alias("x")).select(*columns, "x.pair", "x.n")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, count, best) over all of linked: how many links hold the pair; whether no pair of its second id has more."""
    salted = _each(linked).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counted = cut(salted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(2**_ID_BITS - 1))), "pairs")
    # One row per id of the second tokenizer, so no more than its vocabulary.
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return cut(counted.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, path_a: str, path_b: str, common_pairs: int = COMMON_PAIRS, piece: int = PIECE) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair no other pair of the same second id outnumbers; count_sum: the pairs' counts over the links.
    """
    linked = cut(links(docs, path_a, path_b, piece).withColumn("row", F.monotonically_increasing_id()), "links")
    counts = pair_counts(linked)
    each, figures = _each(linked, "row"), [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    many = counts.count() > common_pairs
    common = counts.orderBy(F.desc("count"), "pair").limit(common_pairs) if many else counts
    sums = each.join(F.broadcast(common), "pair").groupBy("row").agg(*figures)
    if many:
        left = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(counts.hint("merge"), "pair")
        sums = sums.union(left.groupBy("row").agg(*figures)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = linked.drop("linked").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
