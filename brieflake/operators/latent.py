"""Vectors of documents: a truncated singular value decomposition of the hashed tf-idf matrix, by random sketch and power passes.

A row is a document, a column one of COLUMNS buckets of its words; entries are (1 + ln tf) * idf, rows of length one. Texts are read once, their
rows are written. The basis starts as random signs; each pass multiplies it by A'A, which one scan of the sparse rows does (a task sends one
row for each column it has seen; there are no more tasks than cores, so what is sent doesn't grow with the rows), and
makes it orthonormal on the driver. In the end the eigenvectors of the small matrix (A B)'(A B) turn it into right singular
vectors, and a text's vector is its row times these, so texts that come later, such as queries, are embedded alike.

The driver holds COLUMNS x (rank + EXTRA) numbers, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflake.operators.retrieval import tokens
from brieflake.sources.scratch import spread, written

COLUMNS = 1 << 15
RANK = 32
#: Further vectors of the sketch, which make the first ones exact.
EXTRA = 16
PASSES = 4
#: Entries of sparse rows that are worked on at a time.
ENTRIES = 1 << 16


def buckets(text: Column, columns: int) -> Column:
    """The columns of a text's words, in lower case, in order, as often as they come."""
    return F.sort_array(F.transform(F.coalesce(tokens(F.lower(text)), F.array().cast("array<string>")), lambda w: F.pmod(F.xxhash64(w), F.lit(columns)).cast("int")))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, row, column, tf) of the batch in parts of some ENTRIES words."""
    lists = batch.column("cols")
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(lists):
        end = max(start + 1, int(np.searchsorted(at, at[start] + ENTRIES, side="right")) - 1)
        cols = flat[at[start] : at[end]]
        row = np.repeat(np.arange(end - start), np.diff(at[start : end + 1]))
        # runs of the same column within a row
        new = np.ones(len(cols), bool)
        new[1:] = (cols[1:] != cols[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        yield start, end, row[first], cols[first], np.diff(np.append(first, len(cols)))
        start = end


def _weights(row: np.ndarray, cols: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[cols]
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    return w / np.where(norm > 0, norm, 1)[row]


def _times(row: np.ndarray, cols: np.ndarray, w: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times the basis."""
    return np.stack([np.bincount(row, w * basis[cols, j], minlength=n) for j in range(basis.shape[1])], axis=1)


def _few(rows: DataFrame) -> DataFrame:
    """rows in no more tasks than there are cores."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


class Latent:
    """A decomposition fitted on docs (doc_id, content): idf by column, `basis` (COLUMNS x rank right singular vectors), `values` (singular values, falling)."""

    def __init__(self, docs: DataFrame, rank: int = RANK, columns: int = COLUMNS, passes: int = PASSES, extra: int = EXTRA, seed: int = 7):
        self.columns, self.rank = columns, rank
        self.rows = rows = written(spread(docs).select("doc_id", buckets(F.col("content"), columns).alias("cols")), "latent-rows")
        self.n, df = self._counts(rows)
        self.idf = np.log((self.n + 1) / (df + 1)) + 1
        wide = min(rank + extra, max(1, min(columns, self.n)))
        basis = np.random.default_rng(seed).choice([-1.0, 1.0], size=(columns, wide))
        for _ in range(passes):
            basis = np.linalg.qr(self._gram(rows, basis))[0]
        values, turn = np.linalg.eigh(basis.T @ self._gram(rows, basis))
        order = np.argsort(-values)[:rank]
        order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
        self.values, self.basis = np.sqrt(values[order]), basis @ turn[:, order]

    def _counts(self, rows: DataFrame) -> tuple[int, np.ndarray]:
        """The number of rows, and of rows with each column."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(columns + 1, np.int64)
            for batch in batches:
                total[columns] += len(batch)
                for _, _, _, cols, _ in _parts(batch):
                    total[:columns] += np.bincount(cols, minlength=columns)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["c", "n"])

        total = np.zeros(columns + 1, np.int64)
        for r in _few(rows.select("cols")).mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # a number a column
            total[r.c] = r.n
        return int(total[columns]), total[:columns].astype(np.float64)

    def _gram(self, rows: DataFrame, basis: np.ndarray) -> np.ndarray:
        """A'A times the basis, in one scan."""
        shared = rows.sparkSession.sparkContext.broadcast((basis, self.idf))
        wide, columns = basis.shape[1], self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, idf = shared.value
            total = np.zeros((wide, columns))
            for batch in batches:
                for start, end, row, cols, tf in _parts(batch):
                    w = _weights(row, cols, tf, idf, end - start)
                    y = _times(row, cols, w, basis, end - start)
                    for j in range(wide):
                        total[j] += np.bincount(cols, w * y[row, j], minlength=columns)
            seen = np.flatnonzero(np.abs(total).sum(axis=0))
            at = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * wide)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(total[:, seen].T.ravel()))], names=["c", "v"])

        part = _few(rows.select("cols")).mapInArrow(run, "c int, v array<double>").groupBy("c").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(wide)]).alias("v"))
        out = np.zeros(basis.shape)
        got = part.toArrow().combine_chunks()
        if len(got):
            out[got.column("c").to_numpy()] = got.column("v").combine_chunks().flatten().to_numpy().reshape(len(got), wide)
        shared.unpersist()
        return out

    def embed(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, embedding (array<double>, of length one, of zeros where no word has a weight) of texts (key, content)."""
        rows = spread(texts).select(key, buckets(F.col("content"), self.columns).alias("cols"))
        return self._embedded(rows, key)

    def vectors(self) -> DataFrame:
        """embed() of the documents that it was fitted on, from the rows that are written already."""
        return self._embedded(self.rows, "doc_id")

    def _embedded(self, rows: DataFrame, key: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.basis, self.idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis, idf = shared.value
            for batch in batches:
                for start, end, row, cols, tf in _parts(batch):
                    y = _times(row, cols, _weights(row, cols, tf, idf, end - start), basis, end - start)
                    norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
                    y = np.where(norm > 1e-9, y / np.where(norm > 0, norm, 1), 0.0)
                    at = pa.array(np.arange(end - start + 1, dtype=np.int32) * basis.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(start, end - start), pa.ListArray.from_arrays(at, pa.array(y.ravel()))], names=[key, "embedding"])

        return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<double>")
