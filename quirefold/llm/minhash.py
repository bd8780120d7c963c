"""Near-duplicate documents by ProbMinHash.

Every distinct shingle of five words is an element with weight 1 + ln(its count).  An element's Poisson process with that
rate sends arrivals to random registers; a register keeps the element that arrived first.  Once no later arrival of an
element can win any register it stops, so long texts cost little more than one arrival a shingle.  Two sketches agree in
a register with the probability Jaccard similarity of the weighted shingles.

Texts with equal sets of shingles form a class, of which the least doc_id stands for all.  Sketches of representatives
are banded.  A link is defined by the sets alone, so texts that repeat shingles also give the bands of a sketch in which
all weights are one (of other texts both sketches are the same).  Small buckets give all their pairs.  In a larger bucket every member is compared with a hub, the member that
meets most others over all its buckets (of many copies of one text that is the text itself), and then, round after round,
with the hubs of the components it isn't in, until a round finds no link.  That only saves work: large buckets that then
still span components are compared in blocks, every pair of members of different components, by exact counts of common
shingles.  So of the pairs that share a bucket each is verified by the exact Jaccard similarity of the two sets of
shingles, or lies within one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import Scratch, slices, texts, tidy, tune
from .components import components, hook

SHINGLE, REGISTERS, ROWS, SIMILARITY = 5, 80, 4, 0.8
#: Buckets up to this size give all their pairs.
SMALL = 32
#: Rows and bytes of text of one chunk of a large bucket; a task holds two chunks.
CHUNK, CHUNK_BYTES = 1024, 4 << 20
#: Shingles in more rows of a block than this are counted by a matrix product, others pair by pair.
COMMON = 48
U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (row, hash, count), by row and hash; a text of fewer than k words is one shingle, without words none."""
    starts, ends, first = W.word_bounds(data, offsets)
    h = W.word_hashes(data, starts, ends)
    row, ok = W.owners(first, k, len(h))
    row, hashes = row[ok], W.windows(h, k)[ok]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        few = [W.mix(np.array([np.bitwise_xor.reduce(W.mix(h[first[r] : first[r + 1]] + np.arange(1, n[r] + 1).astype(U)))], U))[0] for r in short]
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, np.array(few, U)])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.empty(0, np.int64)
    return row[new], hashes[new], np.diff(np.append(new, len(row)))


def sketches(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m elements that arrived first; rows without elements hold zeros."""
    arrival = np.full(n * m, np.inf)
    winner = np.zeros(n * m, U)
    time = np.zeros(len(element))
    active = np.arange(len(element))
    turn = 0
    while len(active):
        bits = W.mix(element[active] + U(0x9E3779B97F4A7C15 * (2 * turn + 1) % (1 << 64)))
        time[active] += -np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
        register = (W.mix(bits) % U(m)).astype(np.int64) + row[active] * m
        x = time[active]
        np.minimum.at(arrival, register, x)
        won = arrival[register] == x
        winner[register[won]] = element[active[won]]
        last = arrival.reshape(n, m).max(1)
        active = active[x < last[row[active]]]
        turn += 1
    return winner.reshape(n, m)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """n x (m / rows) keys, different in every band."""
    n, m = sketch.shape
    parts = sketch.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=U) + U(1), (n, m // rows)).copy()
    for k in range(rows):
        key = W.mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def all_bands(row: np.ndarray, element: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each row's keys, keys): bands of the weighted sketch, then those of the unweighted one that differ."""
    keys = bands(sketches(row, element, 1 + np.log(count), n))
    repeats = np.unique(row[count > 1])
    per = keys.shape[1]
    both = np.concatenate([keys, keys], 1)
    new = np.zeros(both.shape, bool)
    new[:, :per] = True
    if len(repeats):
        some = np.flatnonzero(np.isin(row, repeats))
        plain = bands(sketches(np.searchsorted(repeats, row[some]), element[some], np.ones(len(some)), len(repeats)))
        new[repeats, per:] = plain != keys[repeats]
        both[repeats, per:] = plain
    return np.append(0, np.cumsum(new.sum(1))), both[new]


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, set_a and set_b (128 bits of the set of shingles, null without words), keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in slices(b.column(1)):
                n = to - at
                row, element, count = shingle_sets(data, offsets)
                bounds, keys = all_bands(row, element, count, n)
                size = np.bincount(row, minlength=n)
                sums = [np.zeros(n, U), np.zeros(n, U)]
                for k, salt in enumerate((U(1), U(0x5851F42D4C957F2D))):
                    np.add.at(sums[k], row, W.mix(element ^ salt))
                columns = [pa.array(s.view(np.int64), mask=size == 0) for s in sums]
                yield pa.record_batch([b.column(0).slice(at, n), *columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64)))], names=["doc_id", "set_a", "set_b", "bands"])

    return docs.mapInArrow(tidy(run), "doc_id long, set_a long, set_b long, bands array<long>")


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Jaccard similarity of the sets (row, hash) of a and b, row by row."""
    keys = [hashes ^ W.mix(row.astype(U)) for row, hashes in (a, b)]
    other = np.sort(keys[1])
    hit = other[np.minimum(np.searchsorted(other, keys[0]), max(0, len(other) - 1))] == keys[0] if len(other) else np.zeros(len(keys[0]), bool)
    both = np.bincount(a[0][hit], minlength=n)
    return both / np.maximum(1, np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n) - both)


def _verify(pairs: DataFrame, kept_texts: DataFrame, similarity: float) -> DataFrame:
    left = kept_texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = kept_texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            at = 0
            while at < n:  # some pairs at a time, by the bytes of the longer texts
                to, size = at, 0
                while to < n and (to == at or size < 4 << 20):
                    size += len(batch.column(2)[to].as_buffer()) + len(batch.column(3)[to].as_buffer())
                    to += 1
                sets = []
                for c in (2, 3):
                    rows, hashes = [], []
                    for x, _, data, offsets in slices(batch.column(c).slice(at, to - at)):
                        r, h, _ = shingle_sets(data, offsets)
                        rows.append(r + x)
                        hashes.append(h)
                    sets.append((np.concatenate(rows), np.concatenate(hashes)))
                good = np.flatnonzero(similarities(sets[0], sets[1], to - at) >= similarity) + at
                yield pa.record_batch([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good))], names=["a", "b"])
                at = to

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def common_counts(row: np.ndarray, hashes: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """len(left) x n numbers of shingles that the rows `left` (ascending) share with each of n rows; (row, hash) are the sets."""
    place = np.full(n, -1)
    place[left] = np.arange(len(left))
    out = np.zeros((len(left), n), np.float32)
    order = np.argsort(hashes, kind="stable")
    row, hashes = row[order], hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(hashes)))
    hot = np.flatnonzero(size > COMMON)
    for at in range(0, len(hot), 1024):
        some = hot[at : at + 1024]
        full = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), size[some])
        full[row[np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(len(column))], column] = 1
        out += full[left] @ full.T
    flat = out.reshape(-1)
    for k in range(2, COMMON + 1):
        some = first[size == k]
        for at in range(0, len(some), max(1, (1 << 20) // (k * k))):
            members = row[some[at : at + max(1, (1 << 20) // (k * k)), None] + np.arange(k)]
            u, v = np.repeat(place[members], k, 1).ravel(), np.tile(members, (1, k)).ravel()
            got, times = np.unique((u * n + v)[u >= 0], return_counts=True)
            flat[got] += times
    return out


def _block(table: pa.Table, similarity: float) -> pa.Table:
    """A forest of the links between members of two chunks (or of one) that lie in different components."""
    ids, part, side = table["doc"].to_numpy(), table["part"].to_numpy(), table["chunk"].to_numpy()
    n, c, d = len(ids), table["c"][0].as_py(), table["d"][0].as_py()
    parts, part, members = np.unique(part, return_inverse=True, return_counts=True)
    a, b = [], []
    if len(parts) > 1:
        rows, hashes = [], []
        for x, _, data, offsets in slices(table["text"]):
            r, h, _ = shingle_sets(data, offsets)
            rows.append(r + x)
            hashes.append(h)
        row, element = np.concatenate(rows), np.concatenate(hashes)
        size = np.bincount(row, minlength=n)
        rest = np.flatnonzero(part != members.argmax())  # the largest component's members need none of their own
        for at in range(0, len(rest), 512):
            left = rest[at : at + 512]
            both = common_counts(row, element, left, n)
            hit = both / np.maximum(1, size[left][:, None] + size - both.astype(np.float64)) >= similarity
            hit &= part[left][:, None] != part
            if c != d:
                hit &= side[left][:, None] != side
            u, v = np.nonzero(hit)
            a.append(left[u])
            b.append(v)
    root = np.arange(n)
    for u, v in zip(a, b):
        root = hook(root, u, v)
    far = np.flatnonzero(root != np.arange(n))
    return pa.table({"a": pa.array(ids[root[far]], pa.int64()), "b": pa.array(ids[far], pa.int64())})


def _blocks(members: DataFrame, kept_texts: DataFrame, similarity: float) -> DataFrame:
    """Links(a, b) that join what all pairs of members(bucket, doc, part) of one bucket and different parts would join."""
    full = members.join(kept_texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    sizes = members.join(kept_texts.select(F.col("doc_id").alias("doc"), F.octet_length("text").alias("bytes")), "doc").groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    dealt = full.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    # a row meets every chunk of its bucket once: the pairs (c, d) of chunks, c <= d, that hold its own
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("bucket", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "chunk", "doc", "part", "text")
    return paired.groupBy("bucket", "c", "d").applyInArrow(lambda t: _block(t, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (least doc_id with the same shingles), component_id (least doc_id of all that links reach), kept.

    kept: doc_id = component_id.  Null and empty texts link with nothing and are kept.  Equal texts link however short;
    rows repeated with their id share its result.  doc_id is meant to be unique and not null: of several texts of one id the
    least one is compared for all of them; rows without an id are kept with null class and component.  An empty table
    stays empty.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "minhash")
    plain = texts(docs, id_col, text_col)
    sketched = scratch.table(_sketched(plain), "sketches")
    classes = scratch.table(sketched.where("set_a IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands")), "classes")

    members = classes.select(F.col("class_id").alias("doc"), F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.table(members.join(sizes, "bucket"), "shared")
    scored = shared.groupBy("doc").agg(F.sum("size").alias("score"))
    buckets = scratch.table(shared.join(scored, "doc").select("bucket", "doc", "size", "score"), "buckets")
    candidates = scratch.table(plain.join(scored.select(F.col("doc").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    scratch.drop("shared")
    scratch.free()

    small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
    ends = small.select("bucket", F.col("doc").alias("other"))
    pairs = small.select("bucket", F.col("doc").alias("a")).join(ends, "bucket").where("a < other").select("a", F.col("other").alias("b"))
    # one row a bucket, written: the join then finds its own exchange, whose hot buckets Spark can split, or none
    hubs = scratch.table(large.groupBy("bucket").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("hub")), "hubs")
    stars = _ordered(large.join(hubs, "bucket").where("doc <> hub"), "doc", "hub")
    tried = scratch.table(pairs.unionByName(stars).distinct(), "pairs-0")
    links = scratch.table(_verify(tried, candidates, similarity), "links-0")
    step = 0
    while True:
        scratch.free()
        found = components(links, scratch, f"round-{step}")
        # members of large buckets that span components, each against the hubs of the components it isn't in
        placed = large.join(found, F.col("doc") == F.col("id"), "left").select("bucket", "doc", "score", F.coalesce("component_id", "doc").alias("part"))
        parts = placed.groupBy("bucket", "part").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("hub"), F.max("score").alias("score"))
        spanned = parts.groupBy("bucket").agg(F.count("*").alias("n"), F.max_by(F.struct("hub", "part"), F.struct("score", -F.col("hub"))).alias("top"), F.min_by(F.struct("hub", "part"), F.struct("score", -F.col("hub"))).alias("low")).where("n > 1")
        tops = scratch.table(spanned.select("bucket", F.explode(F.array("top", "low")).alias("x")).select("bucket", F.col("x.hub").alias("hub"), F.col("x.part").alias("hub_part")), f"tops-{step}")
        more = _ordered(placed.join(tops, "bucket").where("part <> hub_part"), "doc", "hub").distinct().join(tried, ["a", "b"], "left_anti")
        step += 1
        more = scratch.table(more, f"pairs-{step}")
        new = scratch.table(_verify(more, candidates, similarity), f"links-{step}")
        if not new.limit(1).count():
            break
        links, tried = links.unionByName(new), tried.unionByName(more)
    # what hubs left apart: every pair of members that lie in different components
    left = scratch.table(placed.join(spanned.select("bucket"), "bucket").select("bucket", "doc", "part"), "left")
    if left.limit(1).count():
        new = scratch.table(_blocks(left, candidates, similarity), "links-blocks")
        if new.limit(1).count():
            found = components(links.unionByName(new), scratch, "all")
    scratch.drop("texts", "buckets", "left")
    of_set = sketched.join(classes.select("set_a", "set_b", "class_id"), ["set_a", "set_b"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    out = of_set.join(found, F.col("class_id") == F.col("id"), "left").select("doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') || ' ' || CAST(len(words) AS VARCHAR) FROM w WHERE len(words) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS f FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id FROM f),
r AS (SELECT DISTINCT class_id FROM c),
sr AS (SELECT s.* FROM s JOIN r ON s.doc_id = r.class_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sr x JOIN sr y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
reach AS (SELECT class_id AS id, class_id AS via FROM r UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.via),
k AS (SELECT id, min(via) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.component_id, d.doc_id) AS component_id, coalesce(k.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.id = c.class_id
"""
