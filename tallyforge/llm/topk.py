"""Exact top-k inner products over norm-sorted vectors.

Vectors are scaled to integers and sorted by falling length into blocks; each block carries its vectors, their norms
and their coordinates in a basis from an SVD of a bounded sample, in which the first coordinates hold most of the
length. The blocks of candidates are dealt over tasks, once and in slices of bounded size; the blocks of queries stay
where they were written, and every task reads them from there one at a time. It walks its slice in falling length, keeps
each query's k best, passes over blocks whose product of lengths falls below the worst of them, and computes full integer
products only where the partial sum plus the Cauchy-Schwarz bound of the residuals could still win. Slices are dealt by a
hash, so each holds all lengths; their k best are merged exactly.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded
with zeros; the query's own row (same vec_id) is left out; fewer than k candidates give fewer rows; ties go to the
smaller vec_id; repeated ids take part each; scores are exact while |q||c| stays below 2^53; rows without vec_id take
no part; an empty table gives no rows, nor does one without a valid query; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: Vectors in a block of candidates and of queries, candidate blocks in a slice, rows the basis is fitted on. A task holds
#: its slice, one block of queries and the products of one block of each.
CANDIDATES, QUERIES, SLICE, SAMPLE = 512, 4096, 32, 4000
#: Share of the sampled length that the leading coordinates hold.
HELD = 0.8
_BLOCK = "at double, ids binary, vectors binary, n long, d long"


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part, components floor(scale * x)."""
    x = F.col("vector").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    return kept.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))).select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def _blocks(size: int):
    """Rows (vec_id, v) in order to blocks of at most `size` rows, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def block() -> pa.RecordBatch:
            d = max(map(len, rows))
            m = np.zeros((len(rows), d))
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            out = [pa.array([float(np.sqrt((m**2).sum(1)).max())]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(rows)]), pa.array([d])]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["at", "ids", "vectors", "n", "d"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(rows) == size:
                    yield block()
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
        if rows:
            yield block()

    return run


def basis(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthonormal basis (columns) by falling share of the rows' length, and how many coordinates to sum first."""
    if not rows.size:
        return np.eye(rows.shape[1]), rows.shape[1]
    _, s, vt = np.linalg.svd(rows, full_matrices=True)
    held = np.cumsum(s**2) / max(1e-300, float((s**2).sum()))
    return vt.T, min(rows.shape[1], int(np.searchsorted(held, HELD)) + 1)


def _matrix(ids: bytes, vectors: bytes, n: int, d: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros((n, width))
    m[:, :d] = np.frombuffer(vectors, np.float64).reshape(n, d)
    return np.frombuffer(ids, np.int64), m


class Candidates:
    """A block of candidates, with what every block of queries asks of it."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, rotation: np.ndarray, head: int) -> None:
        turned = m @ rotation
        self.ids, self.m, self.lead = ids, m, turned[:, :head]
        self.rest = np.sqrt(np.maximum(0, (turned[:, head:] ** 2).sum(1)))
        self.longest = float(np.sqrt((m**2).sum(1)).max())


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, rotation: np.ndarray, head: int, k: int) -> None:
        self.ids, self.m, self.k = ids, m, k
        turned = m @ rotation
        self.lead, self.rest = turned[:, :head], np.sqrt(np.maximum(0, (turned[:, head:] ** 2).sum(1)))
        self.norm = np.sqrt((m**2).sum(1))
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, block: Candidates) -> None:
        worst = self.scores[:, -1]
        slack = 1e-9 * (1 + self.norm * block.longest)
        # Strictly below the worst kept score: a tie may still win by its id.
        live = np.flatnonzero(self.norm * block.longest + slack >= worst)
        if not len(live):
            return
        bound = self.lead[live] @ block.lead.T + self.rest[live, None] * block.rest[None, :]
        may = bound + slack[live, None] >= worst[live, None]
        use = np.flatnonzero(may.any(0))
        if not len(use):
            return
        ids, c = block.ids, block.m
        exact = np.rint(self.m[live] @ c[use].T)
        exact[~may[:, use] | (self.ids[live, None] == ids[None, use])] = -np.inf
        k = min(self.k, len(use))
        # The k best of the block by score; those that tie with the k-th all stay until ids decide.
        edge = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
        rows, columns = np.nonzero((exact >= np.maximum(edge, worst[live])[:, None]) & np.isfinite(exact))
        for r in np.unique(rows):
            q, own = live[r], columns[rows == r]
            s = np.concatenate([self.scores[q], exact[r, own]])
            i = np.concatenate([self.found[q], ids[use[own]]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.found[q] = s[order], i[order]

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, j]), pa.array(self.scores[q, j].astype(np.int64))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among vectors, both (vec_id, vector)."""
    spark = vectors.sparkSession
    every = scaled(vectors, scale)
    # Ties in length are dealt by a hash, so many equal vectors still spread over the ranges of the sort.
    falling = every.select("vec_id", "v", _norm("v").alias("norm"), F.xxhash64("vec_id").alias("deal")).orderBy(F.desc("norm"), "deal", "vec_id")
    candidates = cut(falling.select("vec_id", "v").mapInArrow(_blocks(CANDIDATES), _BLOCK), "candidates")
    asked = cut(scaled(queries, scale), "asked")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Dealt in turn, so an id that repeats spreads as others do; with room for parts that turn out uneven.
    dealt = asked.select("vec_id", "v").repartition(-(-4 * n // (3 * QUERIES)))
    questions = cut(dealt.mapInArrow(_blocks(QUERIES), _BLOCK), "questions")
    width = int(candidates.select("d").union(questions.select("d")).agg(F.max("d")).first()[0] or 1)
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    m = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        m[i, : len(r["v"])] = r["v"]
    shared = spark.sparkContext.broadcast((*basis(m), questions.inputFiles()))
    # As many slices as the candidates ask for; a few at least, so that a small table isn't one task.
    slices = candidates.repartition(max(4, -(-candidates.count() // SLICE)), F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, head, where = shared.value
        rows = [r for batch in batches for r in batch.select(["ids", "vectors", "n", "d"]).to_pylist()]
        slice_ = [Candidates(*_matrix(r["ids"], r["vectors"], r["n"], r["d"], width), rotation, head) for r in rows]
        slice_.sort(key=lambda c: -c.longest)
        for uri in where if slice_ else ():
            store, path = FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                for batch in parquet.ParquetFile(file).iter_batches(1, columns=["ids", "vectors", "n", "d"]):
                    for r in batch.to_pylist():
                        best = Best(*_matrix(r["ids"], r["vectors"], r["n"], r["d"], width), rotation, head, k)
                        for block in slice_:
                            best.meet(block)
                        yield best.rows()

    part = slices.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
