"""Quality scores by a factorisation machine.

A document is a sparse vector: its distinct words hashed to 2^15 columns and scaled to length one, a bin and a size
column for each structure statistic, and for the character count (the metadata that no label, language,
source or id is part of). A score is the
logistic of w0 + sum(w x) + 1/2 sum_f[(sum v_f x)^2 - sum v_f^2 x^2], linear in the words of the text. Weights are
fitted by AdaGrad on a bounded, seeded sample of labelled rows.

Defined results: null text counts as empty and is scored by its statistics;
without labelled rows every score is 0.5; repeated rows score equally; an empty table gives no rows; other columns
pass through, but those named as the new ones are replaced.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import map_text

WORDS, FACTORS, BINS = 1 << 15, 6, 24
#: Labelled rows learned from at most (about as many are read), and scores from which a document is accepted.
SAMPLE_ROWS, ACCEPT = 5000, 0.3
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b"0123456789"]] = 3
_KIND[[*b" \t\x0b\x0c\r"]] = 4
_KIND[10] = 5
_KIND[128:] = 6


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a document."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    distinct = np.unique(h)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, np.int64)
    n, w = max(1, len(raw)), max(1, len(words))
    letters = max(1, int(kinds[1] + kinds[2] + kinds[6]))
    twice = int((h[1:] == h[:-1]).sum())
    marks = int(kinds[0])
    shares = np.array(
        [
            np.log2(n) / 24,
            np.log2(w) / 20,
            n / w / 24,
            kinds[2] / letters,
            4 * kinds[3] / n,
            4 * marks / n,
            marks / w,
            8 * kinds[5] / w,
            len(distinct) / w,
            4 * twice / w,
            raw.count(b"!") / w,
            2 * raw.count(b"|") / w,
            len(text or "").bit_length() / 24,
        ]
    ).clip(0, 1)
    # Each statistic twice: its bin, and its size in a column of its own.
    at = WORDS + np.arange(len(shares)) * BINS + np.rint(shares * (BINS - 2)).astype(np.int64)
    columns = np.concatenate([distinct % WORDS, at, WORDS + np.arange(1, len(shares) + 1) * BINS - 1]).astype(np.int64)
    values = np.concatenate([np.full(len(distinct), 1 / np.sqrt(max(1, len(distinct)))), np.full(len(shares), 0.5), 2 * shares])
    return columns, values


class Model:
    def __init__(self) -> None:
        size = WORDS + 16 * BINS
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(7).normal(0, 0.05, (size, FACTORS))

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        columns, values = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        starts = np.cumsum([0, *(len(r[0]) for r in rows)])[:-1]
        vx = self.v[columns] * values[:, None]
        pairs = np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx**2, starts)
        return self.bias + np.add.reduceat(self.w[columns] * values, starts) + 0.5 * pairs.sum(1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins([features(t) for t in texts]), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.08, decay: float = 1e-5) -> "Model":
        if not rows:
            return self
        share = np.clip(labels.mean(), 0.02, 0.98)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb, dice = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6, np.random.default_rng(11)
        for _ in range(epochs):
            order = dice.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                own = [rows[i] for i in order[lo : lo + batch]]
                columns, values = (np.concatenate([r[i] for r in own]) for i in (0, 1))
                sizes = [len(r[0]) for r in own]
                of = np.repeat(np.arange(len(own)), sizes)
                starts = np.cumsum([0, *sizes])[:-1]
                vx = self.v[columns] * values[:, None]
                sums = np.add.reduceat(vx, starts)
                margin = self.bias + np.add.reduceat(self.w[columns] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
                slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[order[lo : lo + batch]]
                used, place = np.unique(columns, return_inverse=True)
                each = (slope[of] * values)[:, None]
                parts = np.concatenate([each, each * (sums[of] - vx)], 1)
                grad = np.zeros((len(used), 1 + FACTORS))
                np.add.at(grad, place, parts)
                grad[:, 0] += decay * self.w[used]
                grad[:, 1:] += decay * self.v[used]
                gw[used] += grad[:, 0] ** 2
                gv[used] += grad[:, 1:] ** 2
                gb += slope.sum() ** 2
                self.w[used] -= rate * grad[:, 0] / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * grad[:, 1:] / np.sqrt(gv[used])
                self.bias -= rate * slope.sum() / np.sqrt(gb)
        return self


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from docs joined with labels (doc_id, label 0 or 1): the labelled rows of the lowest seeded hashes.

    About `rows` of them whatever their number; the wanted ids are bounded, so they go to the text by broadcast.
    """
    known = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    total = max(1, known.count())
    part = min(1.0, rows / total)
    wanted = known.where(F.xxhash64("doc_id", F.lit(23)) <= min(2**63 - 1, int(-(2**63) + part * (2**64 - 1)))).limit(2 * rows)
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "label", F.col("text").cast("string").alias("text"))
    sparse = map_text(found, "_columns array<long>, _values array<double>", _both).select("doc_id", "label", "_columns", "_values")
    got = sorted(sparse.collect(), key=lambda r: (r["doc_id"], r["label"], r["_columns"]))
    return Model().fit([(np.array(r["_columns"]), np.array(r["_values"])) for r in got], np.array([r["label"] for r in got]))


def _both(texts: list[str | None]):
    made = [features(t) for t in texts]
    return [m[0] for m in made], [m[1] for m in made]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and `_quality`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, "_quality double", lambda texts: [shared.value.scores(texts)])
