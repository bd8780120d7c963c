"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are words, word shapes (runs of capitals, letters, digits and marks), marks and words said twice in a row, hashed
into buckets.  A bounded sample of labelled texts fixes the buckets in use, their inverse document frequencies and, by a singular value
decomposition, the latent space.  The labelled vectors are broadcast: their number and width are parameters, so their
size never grows with the corpus.  Every text is compared with all of them by blocked exact cosine products, and the
labels of its nearest neighbours are averaged with weights that grow with the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import schema_with, slices, texts, tidy, tune

#: Hash buckets of terms; terms kept; width of the latent space; labelled vectors at most; neighbours that vote.
BUCKETS, TERMS, WIDTH, SAMPLE, NEIGHBOURS = 1 << 15, 1024, 48, 4096, 24
BLOCK = 1024

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the terms of some texts."""
    starts, ends, first = W.word_bounds(data, offsets)
    n, rows = len(offsets) - 1, len(starts)
    row = np.repeat(np.arange(n), np.diff(first))
    words = W.word_hashes(data, starts, ends)
    kind = _CLASS[data]
    run = np.ones(len(data), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[starts] = True
    at = np.concatenate([[0], np.cumsum(run)]).astype(np.int64)
    shapes = W.word_hashes(kind[run], at[starts], at[ends]) if rows else words
    mark = np.flatnonzero(run & ~W.SPACE[data] & (kind != 65) & (kind != 97) & (kind != 48))
    marks = W.mix(kind[mark].astype(np.uint64) + np.uint64(7))
    mark_row = np.searchsorted(offsets, mark, "right") - 1
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1  # a word right after itself
    again = np.tile(again, 3)  # three buckets: one echo weighs more than the words around it
    echoes = W.mix(np.repeat(np.arange(11, 14, dtype=np.uint64), len(again) // 3))
    bucket = np.concatenate([words, W.mix(shapes + np.uint64(1)), marks, echoes]) % np.uint64(BUCKETS)
    key = np.concatenate([row, row, mark_row, row[again]]) * BUCKETS + bucket.astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


@dataclass(frozen=True)
class Model:
    """column: of each bucket (-1: unused); project: terms x width, idf included; vectors: unit rows; prior: mean label."""

    column: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def embed(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        column = self.column[bucket]
        used = column >= 0
        row, column, weight = row[used], column[used], (1 + np.log(count[used])).astype(np.float32)
        out = np.zeros((n, self.project.shape[1]), np.float32)
        if len(row):
            edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[edge]] = np.add.reduceat(self.project[column] * weight[:, None], edge, axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean label of the nearest, weighted by similarity; the prior where a text has no known term."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(self.neighbours, len(self.vectors))
        for at in range(0, len(x), BLOCK):
            cos = x[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(cos, len(self.vectors) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            out[at : at + BLOCK] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fold that no model learns from: crc32 of the id as text divisible by five; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, n_terms: int = TERMS, width: int = WIDTH, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most `sample` labelled rows outside the held-out fold, drawn by the hash of their ids.

    Several labels of one id count as their maximum, of several texts of one id the least is taken; null labels, and labels
    of unknown documents, are left out.
    Without any label the model scores everything 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in slices(b.column(1)):
                row, bucket, count = terms(data, offsets)
                edge = np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v.astype(np.int32))) for v in (bucket, count)]
                yield pa.record_batch([b.column(0).slice(at, to - at), b.column(2).slice(at, to - at), *lists], names=["doc_id", "label", "buckets", "counts"])

    # the drawn ids have a proven bound, so they may be broadcast; one text for each comes back, however often its id repeats
    of_id = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = of_id.select("doc_id", "text", "label").mapInArrow(tidy(run), "doc_id long, label int, buckets array<int>, counts array<int>").toArrow().sort_by("doc_id")
    n = got.num_rows
    if not n:
        return Model(np.full(BUCKETS, -1), np.zeros((1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, neighbours)
    lists = got["buckets"].combine_chunks()
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    bucket, count = lists.flatten().to_numpy(), got["counts"].combine_chunks().flatten().to_numpy()
    y = got["label"].to_numpy().astype(np.float64)
    often = np.bincount(bucket, minlength=BUCKETS)
    chosen = np.argsort(-often, kind="stable")[:n_terms]
    chosen = np.sort(chosen[often[chosen] > 1]) if (often > 1).any() else np.sort(chosen)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    idf = np.log((1 + n) / (1 + often[chosen])) + 0.1
    x = np.zeros((n, len(chosen)), np.float32)
    used = column[bucket] >= 0
    x[row[used], column[bucket[used]]] = (1 + np.log(count[used])) * idf[column[bucket[used]]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    top = vectors[:, ::-1][:, : min(width, len(chosen))]
    model = Model(column, (idf[:, None] * top).astype(np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()), neighbours)
    return Model(column, model.project, model.embed(row, bucket, count, n), y, model.prior, neighbours)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from the threshold on); columns of these names are replaced.

    No shuffle.  Null and empty texts score the share of label 1 in the sample.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("score", "predicted")
    shared, where = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = [model.score(model.embed(*terms(data, offsets), to - at)) for at, to, data, offsets in slices(b.column(where))]
            if scores:
                s = np.concatenate(scores)
                yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema_with(docs, ("score", "double"), ("predicted", "integer")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts score the share of label 1 among the learnt rows (0.5 without any).  Repeated and null ids stay,
    row for row; null ids are never held out nor learnt from; an empty table stays empty.
    """
    plain = texts(docs)
    scored = score(plain, fit(plain, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
