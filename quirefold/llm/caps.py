"""Near-duplicate vectors by spherical-cap filters.

A vector is cut into two blocks; each block has its own codebook of random unit vectors, and every pair of codewords is a
filter: a cap of the directions near the sum of both.  A vector lies in the caps with its `nearest` largest sums of inner
products, which list decoding finds in the tops of the two sorted lists: of caps ranked r and s there, those with
r * s <= nearest.  So every vector lies in as many caps, wherever it points; with one threshold for all sums some vectors
had hundreds of caps and others hardly any, and the mean that a recall needs was several times as high.
Vectors that share a cap are compared exactly, in double precision.  A fixed random rotation comes first, so that it doesn't
matter how a vector's energy lies over its components; a short vector is turned into a space of WIDTH components.  There are
so many caps that about `bucket` vectors share one, and a vector lies in as many as random pairs at the least cosine need
for a recall of RECALL.  Where all vectors of a length fit a chunk, one cap holds them all.

Equal vectors are one class, so a vector that a third of all rows hold is compared once.  Classes go to groups of caps
(a codeword of the first block and a range of the second's) and, where a group is large, to pairs of its chunks.  A pair
found under several caps counts under the least one alone, so no list of pairs is ever written: a task gives the links of
each vector and one forest of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, tune
from .components import components, hook

COSINE, BUCKET = 0.9, 64
#: Least share of random pairs at the least cosine that share a cap, and how many pairs a design is measured by.
RECALL, TRIALS = 0.985, 2000
#: Caps of a vector, from the fewest that are tried to those beyond which caps become wider instead; least components that are cut into blocks.
FEWEST, MOST, WIDTH = 4, 64, 16
#: Classes of one chunk; a task holds two chunks of one group of caps.
CHUNK = 2048
#: Pairs whose lists of caps are compared at once.
PAIRS = 16384


@dataclass(frozen=True)
class Caps:
    words: int  # codewords of a block
    nearest: int  # caps of a vector
    ranges: int  # of the second block's codewords, for groups

    def books(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([20240229, length, self.words])
        out = []
        for size in (length // 2, length - length // 2):
            book = rng.standard_normal((self.words, size))
            out.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(size))
        return out[0], out[1]


@lru_cache(maxsize=8)
def rotation(length: int) -> np.ndarray:
    """Orthonormal rows, one for each component of a vector."""
    width = max(length, WIDTH)
    q, r = np.linalg.qr(np.random.default_rng([20240301, width]).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:length]


def recall(caps: Caps, length: int, cosine: float, pairs: int = TRIALS) -> float:
    """The share of random pairs at this cosine that share a cap."""
    rng = np.random.default_rng([20240302, length])
    hit = 0
    for at in range(0, pairs, 200):
        a, b = rng.standard_normal((2, min(200, pairs - at), length))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.linalg.norm(b, axis=1, keepdims=True)
        (row, x), (other, y) = decode(a, caps), decode(b, caps)
        both = np.intersect1d(row * caps.words**2 + x, other * caps.words**2 + y) // caps.words**2
        hit += len(np.unique(both))
    return hit / pairs


def design(n: int, length: int, cosine: float = COSINE, bucket: int = BUCKET) -> Caps:
    """Caps for n vectors of a length: more caps of a vector, at about as many vectors a cap, until random pairs meet RECALL."""
    if n <= CHUNK or length < 2:  # one component: two directions at most
        return Caps(1, 1, 1)
    nearest, words = FEWEST, math.ceil(math.sqrt(n * FEWEST / bucket))
    while cosine < 1 and words**2 > nearest and recall(Caps(words, nearest, 1), length, cosine) < RECALL:
        if nearest < MOST:
            nearest += 1
            words = math.ceil(math.sqrt(n * nearest / bucket))
        else:  # where more caps don't help, wider ones do
            words = int(words / 1.15)
    if words**2 <= nearest:
        return Caps(1, 1, 1)
    ranges = math.ceil(n * nearest / words / CHUNK)  # a codeword and a range then gather about a chunk
    return Caps(words, nearest, min(words, ranges))


def decode(x: np.ndarray, caps: Caps) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every cap that holds a unit row of x, by row and filter."""
    x = x @ rotation(x.shape[1])
    half, top = x.shape[1] // 2, min(caps.words, caps.nearest)
    lists = []
    for block, book in zip((x[:, :half], x[:, half:]), caps.books(x.shape[1])):
        products = block @ book.T
        best = np.argpartition(-products, top - 1, axis=1)[:, :top]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(products, best, 1), axis=1, kind="stable"), 1)
        lists.append((best, np.take_along_axis(products, best, 1)))
    (one, a), (two, b) = lists
    r, s = np.nonzero(np.outer(np.arange(1, top + 1), np.arange(1, top + 1)) <= caps.nearest)
    pick = np.argpartition(-(a[:, r] + b[:, s]), caps.nearest - 1, axis=1)[:, : caps.nearest]
    found = np.take_along_axis(one, r[pick], 1) * caps.words + np.take_along_axis(two, s[pick], 1)
    return np.repeat(np.arange(len(x)), caps.nearest), np.sort(found, axis=1).ravel()


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; the largest component is divided out first, so that no norm overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id, length, v (components as bytes of this kind) and key (equal for equal directions); null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, n = b.column(1), b.num_rows
            values = lists.values.cast(pa.float64())
            flat = values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 and 0.0 are equal
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            good = lists.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
            raw, keys = [None] * n, [None] * n
            for length in np.unique(sizes[good]):
                at = np.flatnonzero(good & (sizes == length))
                x = flat[offsets[at][:, None] + np.arange(length)]
                fit = np.isfinite(x).all(1) & (x != 0).any(1)  # a null component reads as NaN
                at, x = at[fit], x[fit]
                scaled = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
                for k, v, u in zip(at.tolist(), x.astype(kind), scaled):
                    raw[k], keys[k] = v.tobytes(), hashlib.sha256(u.tobytes()).digest()
            yield pa.record_batch([b.column(0), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "length", "v", "key"])

    return vectors.mapInArrow(run, "vec_id long, length int, v binary, key binary")


def _filed(classes: DataFrame, designs: dict[int, Caps], kind: str) -> DataFrame:
    """One row for each class and group of caps: length, part, id, weight, the vector, all caps of the vector (32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights, sizes, vectors = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            for length in np.unique(sizes):
                at, caps = np.flatnonzero(sizes == length), designs[int(length)]
                row, found = decode(units(np.frombuffer(b"".join(vectors[at]), kind).reshape(len(at), -1)), caps)
                group = found // caps.words * caps.ranges + found % caps.words * caps.ranges // caps.words
                bounds = np.searchsorted(row, np.arange(len(at) + 1))
                pair = np.unique(np.stack([row, group], 1), axis=0) if len(row) else np.empty((0, 2), np.int64)
                own = at[pair[:, 0]]
                lists = [found[bounds[r] : bounds[r + 1]].astype("<u4").tobytes() for r in range(len(at))]
                yield pa.record_batch(
                    [pa.array(np.full(len(own), length, np.int32)), pa.array(pair[:, 1]), pa.array(ids[own]), pa.array(weights[own]), pa.array(vectors[own], pa.binary()), pa.array([lists[r] for r in pair[:, 0]], pa.binary())],
                    names=["length", "part", "id", "weight", "vector", "caps"],
                )

    return classes.mapInArrow(run, "length int, part long, id long, weight long, vector binary, caps binary")


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of ascending ids padded by -1: the least id in both, or -1."""
    out = np.full(len(a), -1)
    open_ = np.arange(len(a))
    for k in range(a.shape[1]):
        v = a[open_, k]
        hit = (v >= 0) & (b[open_] == v[:, None]).any(1)
        out[open_[hit]] = v[hit]
        open_ = open_[~hit & (v >= 0)]
        if not len(open_):
            break
    return out


def _compare(table: pa.Table, caps: Caps, cosine: float, kind: str) -> pa.Table:
    """Links of two chunks of a group (or of one with itself) whose least common cap lies in the group.

    A pair that several caps of the group hold is looked at under the first of them alone.
    """
    table = table.sort_by("id")  # the order of rows is then that of ids
    part, c, d = (table[k][0].as_py() for k in ("part", "c", "d"))
    ids, weights, side = table["id"].to_numpy(), table["weight"].to_numpy(), table["chunk"].to_numpy()
    x = units(np.frombuffer(b"".join(table["vector"].to_pylist()), kind).reshape(len(ids), -1))
    lists = table["caps"].to_pylist()
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    padded = np.full((len(ids), int(sizes.max())), -1)
    padded[np.arange(padded.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(lists), "<u4")
    group_of = lambda cap: np.where(cap >= 0, cap // caps.words * caps.ranges + cap % caps.words * caps.ranges // caps.words, -1)
    row, column = np.nonzero(group_of(padded) == part)
    by = padded[row, column]
    order = np.argsort(by, kind="stable")
    links, root, seen = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros((len(ids), len(ids)), bool)
    bounds = np.flatnonzero(np.append(True, np.diff(by[order]) != 0)).tolist() + [len(order)]
    for begin, end in zip(bounds[:-1], bounds[1:]):
        members = row[order[begin:end]]
        for left in range(0, len(members), 512):
            m, rest = members[left : left + 512], members[left:]
            hit = (x[m] @ x[rest].T >= cosine - 1e-9) & (m[:, None] < rest)
            if c != d:
                hit &= side[m][:, None] != side[rest]
            hit &= ~seen[m[:, None], rest]
            u, v = np.nonzero(hit)
            u, v = m[u], rest[v]
            seen[u, v] = True
            for k in range(0, len(u), PAIRS):
                p, q = u[k : k + PAIRS], v[k : k + PAIRS]
                exact = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[exact], q[exact]
                first = group_of(_least_common(padded[p], padded[q])) == part
                p, q = p[first], q[first]
                np.add.at(links, p, weights[q])
                np.add.at(links, q, weights[p])
                root = hook(root, p, q)
    got = np.flatnonzero(links)
    return pa.table({"id": pa.array(ids[got]), "links": pa.array(links[got]), "root": pa.array(ids[root[got]])})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", bucket: int = BUCKET) -> DataFrame:
    """Per vector: vec_id, n_links (other rows at the least cosine or above), component_id, kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept; so do
    vectors of different length among each other.  Rows with equal vectors always link.  Every link is exact; a pair is
    missed only where no cap holds both (at most 1.5 % of random pairs at the least cosine, as measured for the design in use;
    none where a length has at most CHUNK different vectors).  Ids are meant to be unique and not null; rows without one are
    kept with null component and no links.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "caps")
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = "<f4" if isinstance(plain.schema["v"].dataType.elementType, FloatType) else "<f8"
    keyed = scratch.table(_keyed(plain, kind), "vectors")
    classes = scratch.table(keyed.where("key IS NOT NULL").groupBy("length", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min_by("v", "vec_id").alias("v")), "classes")
    # one row for each length of vectors
    designs = {r.length: design(r.n, r.length, cosine, bucket) for r in classes.groupBy("length").agg(F.count("*").alias("n")).collect()}
    filed = scratch.table(_filed(classes.select("id", "weight", "length", "v"), designs, kind), "filed")
    sizes = filed.groupBy("length", "part").agg(F.count("*").alias("n"))
    dealt = filed.join(sizes, ["length", "part"]).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # a row meets every chunk of its group once: the pairs (c, d) of chunks, c <= d, that hold its own
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("length", "part", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "chunk", "id", "weight", "vector", "caps")
    compared = paired.groupBy("length", "part", "c", "d").applyInArrow(lambda t: _compare(t, designs[t["length"][0].as_py()], cosine, kind), "id long, links long, root long")
    found = scratch.table(compared, "found")
    scratch.drop("filed")
    scratch.free()
    linked = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.join(counts, "id", "left").join(linked, "id", "left").select("length", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = keyed.select("vec_id", "length", "key").join(per_class, ["length", "key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, v, n FROM g WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
reach AS (SELECT vec_id AS id, vec_id AS via FROM u UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.via),
k AS (SELECT id, min(via) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.id = e.vec_id
"""
