"""Packing token runs into fixed windows by minimum bin slack.

Each window is seeded with the longest waiting run; a bitset subset-sum dynamic programme over the multiset of
waiting lengths then finds the reachable fill closest to capacity, and walking its steps back gives how many runs
of each length to take. Runs longer than a window are cut into full windows first. Every task packs its own rows
in bounded memory, so nothing is shuffled; only the last, underfull window of a task would waste padding, and it is
cut into windows whose lengths are powers of two, which need none.

Defined results: null or empty text has the end id alone; repeated rows are packed once each; a null doc_id stays
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words a Python worker keeps with their ids (about 85 MB at most).
CACHE_WORDS = 300_000
#: Runs and tokens that may wait before windows are closed.
WAITING_RUNS, WAITING_TOKENS = 4096, 4_000_000
#: An underfull last window with at least this slack is cut at powers of two.
CUT_SLACK = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_CACHES: dict[str, "WordIds"] = {}


def _ranges(test) -> str:
    """A regular expression's class body for the code points below U+0300 that pass a test."""
    return "".join(re.escape(chr(c)) for c in range(0x300) if test(chr(c)))


class WordIds(dict):
    """Ids of whole texts by a lower-casing word BPE, as little-endian uint32 bytes, with words looked up once.

    The vocabulary file splits text into words before merging and never merges across words, so ids of a text are
    the ids of its words joined. The word pattern here is the file's own, valid below U+0300 where lower-casing and
    composition are the same in Python; any other text goes through the library as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and bool(self.whole.model)
        self.model = self.whole.model
        letters, numbers = (_ranges(lambda ch, k=k: unicodedata.category(ch)[0] == k) for k in "LN")
        blank = r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")
        self.other = re.compile("[^\x00-˿]|<\\|")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in shown]
        self.letter_of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        piece = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letter_of)
        got = np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if self.by_word and not self.other.search(text):
            return b"".join(map(self.__getitem__, self.words.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def closest_fill(lengths: list[int], counts, capacity: int) -> dict[int, int]:
    """How many runs of each length fill `capacity` best without passing it; `lengths` in the order to prefer."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for n in lengths:
        left, take = min(int(counts[n]), capacity // n), 1
        while left > 0:
            take = min(take, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, take = left - take, take * 2
        if reach >> capacity:
            break
    fill, use = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(steps):
        if not before >> fill & 1:
            use[n] += take
            fill -= n * take
    return use


class Packer:
    """Windows for the runs of one task."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id = size, first_id
        self.counts = np.zeros(size + 1, np.int64)
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.runs = self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at, window = 0, self.size
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        if at & (at - 1) == 0:
            window = at
        self.rows[-len(pieces) :] = [(*r, window) for r in self.rows[-len(pieces) :]]
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, full = len(ids) // 4, self.size * 4
        at = 0
        while len(ids) - at >= full:
            self._emit([(doc_id, at // 4, ids[at : at + full], total)])
            at += full
        if at < len(ids):
            n = (len(ids) - at) // 4
            self.waiting[n].append((doc_id, at // 4, ids[at:], total))
            self.counts[n] += 1
            self.runs, self.tokens = self.runs + 1, self.tokens + n
        if self.runs > WAITING_RUNS or self.tokens > WAITING_TOKENS:
            self.close(self.runs // 2, self.tokens // 2)

    def close(self, runs: int = 0, tokens: int = 0, last: bool = False) -> None:
        """Close windows until at most so many runs and tokens wait."""
        while self.runs > runs or self.tokens > tokens:
            present = np.flatnonzero(self.counts)[::-1].tolist()
            first = present[0]
            self.counts[first] -= 1
            use = closest_fill(present, self.counts, self.size - first)
            self.counts[first] += 1
            use[first] += 1
            for _ in range(min(int(self.counts[n]) // k for n, k in use.items())):
                pieces = [self.waiting[n].popleft() for n, k in sorted(use.items(), reverse=True) for _ in range(k)]
                self.runs, self.tokens = self.runs - len(pieces), self.tokens - sum(n * k for n, k in use.items())
                if last and self.size - sum(n * k for n, k in use.items()) >= CUT_SLACK:
                    self._emit_powers(pieces)
                else:
                    self._emit(pieces)
            for n, _ in use.items():
                self.counts[n] = len(self.waiting[n])
                if not self.waiting[n]:
                    del self.waiting[n]

    def _emit_powers(self, pieces: list[tuple]) -> None:
        """Cut what an underfull window holds into windows of power-of-two lengths."""
        left, queue = sum(len(p[2]) // 4 for p in pieces), deque(pieces)
        while left:
            room = window = 1 << (left.bit_length() - 1)
            own = []
            while room:
                doc_id, start, ids, total = queue.popleft()
                n = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    queue.appendleft((doc_id, start + n, ids[4 * n :], total))
                room -= n
            self._emit(own)
            left -= window


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: where it comes from (doc_id, start, length), its ids' checksum and where it lies.

    `window` is the padded length of the piece's sequence: `size`, or the sequence's own length at a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 33)
        types = [pa.int64()] * len(_COLUMNS)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * len(_COLUMNS)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, words.ids(text.as_py() or "") + end)
            if len(packer.rows) >= 20_000:
                yield out()
        packer.close(last=True)
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
