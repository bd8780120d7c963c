"""Substring dedup by prefix-partitioned suffix trees.

A repeat is a window of `width` words that starts in two documents.  Of all half windows (width / 2 words) inside a window
the one with the least hash is its anchor: equal windows have equal anchors at equal places, so only suffixes that start at
anchors enter trees, filed by their first width / 2 words.  Prefixes that only one document holds give no repeat and are
dropped before any text moves.

A tree grows word by word from the prefix to the right, another one from the same place to the left.  A window is a pair
of nodes, one of each tree, whose depths add up to `width`: an internal node of that depth with leaves of several documents
is a repeat, and successive windows of such nodes are a maximal one.  Words are compared as bytes, so equal hashes of
different words do no harm.

All suffixes of some prefixes fit a task's memory, unless a prefix has more than GROUP.  Those of such a prefix are dealt to
parts of about GROUP, each with its trees, which settle all leaves but those of a node's least document in the part.  For
these the prefix is made longer, to the whole window: of its subtree there the node alone is left, known by 128 bits of hash,
and its least document over all parts, an aggregation that combines before it moves.  However many documents share a
passage, no task meets all its leaves, and only a part's least document of a node goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import wordhash as W
from .common import Scratch, slices, texts, tidy, tune

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Suffixes of one prefix that are put into one tree; a prefix with more is dealt to parts.
GROUP = 2048
#: Bytes of text of the suffixes whose trees are built together.
TREE_BYTES = 2 << 20
_LOW = W.U(0xFFFFFFFF)
SUFFIXES = "label long, part int, parts int, doc_id long, mark long, start int, before int, windows int, words string"
#: node_a and node_b are null where the windows have a smaller document in any case.
FOUND = "doc_id long, mark long, from_start int, to_start int, node_a long, node_b long"


def _anchors(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one anchor: row, first window, windows of the run, anchor; and the half windows' hashes."""
    half = width // 2
    halves = W.windows(h, half)
    # by the upper 32 bits of the hash, then the leftmost: a place that the window's words alone decide
    key = (halves & ~_LOW) | np.arange(len(halves), dtype=W.U)
    anchor = (W.sliding_min(key, width - half + 1) & _LOW).astype(np.int64)
    row, ok = W.owners(first, width, len(h))
    at = np.flatnonzero(ok)
    row, anchor = row[at], anchor[at]
    begin = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) if len(at) else at
    return row[begin], at[begin], np.diff(np.append(begin, len(at))), anchor[begin], halves


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _labels(docs: DataFrame, width: int) -> DataFrame:
    """label (hash of a prefix), doc_id, mark, n (anchors): of docs(doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in slices(b.column(1)):
                starts, ends, first = W.word_bounds(data, offsets)
                row, _, _, anchor, halves = _anchors(W.word_hashes(data, starts, ends), first, width)
                label = halves[anchor]
                order = np.lexsort((label, row))
                row, label = row[order], label[order]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1]))) if len(row) else order
                place = pa.array(row[new])
                yield pa.record_batch([_signed(label[new]), b.column(0).slice(at, to - at).take(place), b.column(2).slice(at, to - at).take(place), pa.array(np.diff(np.append(new, len(row))).astype(np.int32))], names=["label", "doc_id", "mark", "n"])

    return docs.mapInArrow(tidy(run), "label long, doc_id long, mark long, n int")


def _parts(lists: pa.ListArray, at: int, to: int, row: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many parts each label has by its row's list of (label, parts); 0 where it is not in it."""
    bounds, values = lists.offsets.to_numpy(), lists.values
    labels, parts = values.field(0).to_numpy().view(np.uint64)[bounds[at] : bounds[to]], values.field(1).to_numpy()[bounds[at] : bounds[to]]
    if not len(labels):
        return np.zeros(len(label), np.int64)
    keys = labels ^ W.mix(np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1])).astype(np.uint64))
    order = np.argsort(keys)
    keys, parts = keys[order], parts[order].astype(np.int64)
    key = label ^ W.mix(row.astype(np.uint64))
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[place] == key, parts[place], 0)


def _suffixes(docs: DataFrame, width: int) -> DataFrame:
    """Of docs(doc_id, text, mark, labels): the suffixes at anchors with these labels, and the words to both sides that their windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(2).to_numpy()
            for at, to, data, offsets in slices(b.column(1)):
                starts, ends, first = W.word_bounds(data, offsets)
                row, window, count, anchor, halves = _anchors(W.word_hashes(data, starts, ends), first, width)
                parts = _parts(b.column(3), at, to, row, halves[anchor])
                hit = parts > 0
                row, window, count, anchor, parts = row[hit], window[hit], count[hit], anchor[hit], parts[hit]
                if not len(row):
                    continue
                place, whole, start = pa.array(row), data.tobytes(), window - first[row]
                words = [whole[x:y] for x, y in zip(starts[window].tolist(), ends[window + count + width - 2].tolist())]
                part = W.mix(marks[at + row].view(np.uint64) ^ W.mix(start.astype(np.uint64))) % parts.astype(np.uint64)
                columns = [pa.array(x.astype(np.int32)) for x in (part, parts, start, anchor - window, count)]
                yield pa.record_batch([_signed(halves[anchor]), *columns[:2], b.column(0).slice(at, to - at).take(place), b.column(2).slice(at, to - at).take(place), *columns[2:], pa.array(words, pa.binary()).cast(pa.string())], names=[c.split()[0] for c in SUFFIXES.split(", ")])

    return docs.mapInArrow(tidy(run), SUFFIXES)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for words of equal bytes."""
    h = W.word_hashes(data, starts, ends)
    _, model, number = np.unique(h, return_index=True, return_inverse=True)
    sizes, other = ends - starts, model[number]
    same = sizes == sizes[other]
    if same.all():
        at = _counting(sizes)
        same = (data[np.repeat(starts, sizes) + at] == data[np.repeat(starts[other], sizes) + at]).all()
    if np.all(same):
        return number
    whole, known = data.tobytes(), {}
    return np.array([known.setdefault(whole[x:y], len(known)) for x, y in zip(starts.tolist(), ends.tolist())])


def _grow(root: np.ndarray, words: np.ndarray, place: np.ndarray, step: int, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Node of each suffix (row) at each depth (column) of a tree: nodes are numbered over all depths, -1 beyond a suffix's end."""
    out = np.full((len(root), depth + 1), -1, np.int64)
    out[:, 0] = root
    base, size = int(root.max(initial=-1)) + 1, int(words.max(initial=0)) + 1
    open_ = np.arange(len(root))
    for k in range(1, depth + 1):
        open_ = open_[lengths[open_] >= k]
        if not len(open_):
            break
        child, node = np.unique(out[open_, k - 1] * size + words[place[open_] + step * (k - 1)], return_inverse=True)
        out[open_, k] = base + node
        base += len(child)
    return out


class Trees:
    """The trees of some suffixes, which come by group (prefix and part): `before` words of a suffix's text precede the prefix, `count` windows reach it."""

    def __init__(self, group: np.ndarray, before: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        half = width // 2
        starts, ends, self.first = W.word_bounds(data, offsets)
        self.data, self.starts, self.ends, self.width = data, starts, ends, width
        words = word_numbers(data, starts, ends)
        place = self.first[:-1] + before
        prefix = words[place[:, None] + np.arange(half)]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        group = np.cumsum(np.append(0, group[1:] != group[:-1]))
        if (prefix != prefix[head[group]]).any():  # one hash of different prefixes
            group = np.unique(np.column_stack([group, prefix]), axis=0, return_inverse=True)[1].ravel()
        rest = width - half
        right = _grow(group, words, place + half, 1, rest - before + count - 1, rest)
        left = _grow(group, words, place - 1, -1, before, rest)
        #: Of every window: its suffix, its number within it, and its node.
        self.suffix, self.window = np.repeat(np.arange(len(count)), count), _counting(count)
        depth = before[self.suffix] - self.window  # words to the left of the prefix
        self.node = left[self.suffix, depth] * (int(right.max(initial=0)) + 1) + right[self.suffix, rest - depth]

    def marked(self, doc: np.ndarray) -> np.ndarray:
        """Which windows a suffix of a smaller document holds too."""
        doc = doc[self.suffix]
        order = np.argsort(self.node, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(self.node[order]) != 0))
        out = np.zeros(len(order), bool)
        out[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
        return out

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, first, last window) of successive windows that are marked."""
        at = np.flatnonzero(marked)
        begins = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(self.suffix[at]) != 0))) if len(at) else at
        stops = (np.append(begins[1:], len(at)) - 1)[: len(begins)]
        return self.suffix[at[begins]], self.window[at[begins]], self.window[at[stops]]

    def hashes(self, which: np.ndarray) -> list[np.ndarray]:
        """128 bits, in two numbers, of the words of these windows."""
        h = W.word_hashes(self.data, self.starts, self.ends)
        at = self.first[self.suffix[which]] + self.window[which]
        return [W.windows(x, self.width)[at] for x in (h, W.mix(h ^ W.U(0x5851F42D4C957F2D)))]


def _trees(suffixes: DataFrame, width: int) -> DataFrame:
    """FOUND: runs of windows that a smaller document holds too, and, of prefixes in several parts, the windows that a part does not settle."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def build(t: pa.Table) -> Iterator[pa.RecordBatch]:
        label, part, parts, doc, before, count, start = (t[c].to_numpy() for c in ("label", "part", "parts", "doc_id", "before", "windows", "start"))
        words = t["words"].combine_chunks().cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        group = np.cumsum(np.append(0, (label[1:] != label[:-1]) | (part[1:] != part[:-1])))
        trees = Trees(group, before.astype(np.int64), count.astype(np.int64), data, offsets - offsets[0], width)
        marked = trees.marked(doc)
        ids, marks = t["doc_id"].combine_chunks(), t["mark"].combine_chunks()

        def rows(suffix: np.ndarray, begin: np.ndarray, end: np.ndarray, nodes: list[pa.Array]) -> pa.RecordBatch:
            return pa.record_batch([ids.take(pa.array(suffix)), marks.take(pa.array(suffix)), *(pa.array((start[suffix] + x).astype(np.int32)) for x in (begin, end)), *nodes], names=names)

        found = trees.runs(marked)
        yield rows(*found, [pa.nulls(len(found[0]), pa.int64())] * 2)
        open_ = np.flatnonzero(~marked & (parts[trees.suffix] > 1))
        if len(open_):
            yield rows(trees.suffix[open_], trees.window[open_], trees.window[open_], [_signed(x) for x in trees.hashes(open_)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= TREE_BYTES:
                t = pa.Table.from_batches(held)
                label, part = t["label"].to_numpy(), t["part"].to_numpy()
                other = np.flatnonzero((label != label[-1]) | (part != part[-1]))
                if len(other):  # the last group may go on in the next batch
                    yield from build(t.slice(0, other[-1] + 1))
                    held = t.slice(other[-1] + 1).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from build(pa.Table.from_batches(held))

    return suffixes.repartition("label", "part").sortWithinPartitions("label", "part").mapInArrow(tidy(run), FOUND)


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = 50) -> DataFrame:
    """doc_id, mark, `froms` and `tos`: runs (first, last start) of windows that start in a smaller document too; of docs(doc_id, text, mark)."""
    labels = scratch.table(_labels(docs, width), "labels")
    shared = labels.groupBy("label").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("n")).where("least < most").select("label", F.ceil(F.col("n") / max(1, GROUP)).cast("int").alias("parts"))
    # a text has at most as many labels as words: this array is never longer than it
    of_text = labels.join(shared, "label").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("label", "parts")).alias("labels"))
    suffixes = _suffixes(docs.join(of_text, ["doc_id", "mark"]).select("doc_id", "text", "mark", "labels"), width)
    found = scratch.table(_trees(suffixes, width), "found")
    scratch.drop("labels")
    scratch.free()
    leaves = found.where("node_a IS NOT NULL")
    # written, so that the join below has exchanges of its own, whose hot nodes Spark can split
    nodes = scratch.table(leaves.groupBy("node_a", "node_b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("node_a", "node_b", "least"), "nodes")
    more = leaves.join(nodes, ["node_a", "node_b"]).where("doc_id > least").select(*found.columns)
    out = scratch.table(found.where("node_a IS NULL").unionByName(more).groupBy("doc_id", "mark").agg(F.collect_list("from_start").alias("froms"), F.collect_list("to_start").alias("tos")), "repeated")
    scratch.drop("found", "nodes")
    scratch.free()
    return out


def _apply(docs: DataFrame, repeated: DataFrame, width: int, texts_too: bool) -> DataFrame:
    more = [c for c in docs.columns if c == "carried"]
    joined = docs.join(repeated.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"}), (F.col("doc_id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "froms", "tos", *more)
    schema = RESULT + (", kept string" if texts_too else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, froms, tos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = text.encode().split()  # at the same bytes as the windows
                n, removed = len(words), 0
                if froms.is_valid:
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, froms.values.to_numpy(), 1)
                    np.add.at(steps, tos.values.to_numpy() + width, -1)
                    gone = np.cumsum(steps)[:n] > 0
                    removed = int(gone.sum())
                    words = list(compress(words, (~gone).tolist()))
                kept = b" ".join(words)
                rows.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), *([(kept.decode() if removed else text)] if texts_too else [])))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)] + [b.column(4 + k) for k in range(len(more))], names=names + more)

    return joined.mapInArrow(tidy(run), StructType(StructType.fromDDL(schema).fields + [docs.schema[c] for c in more]))


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of `width` words whose sequence also starts in a document with a smaller id.

    Windows are judged on the input.  Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and on demand the text: unchanged where nothing is removed, else the kept words joined by one space.  Null
    and empty texts have no words.  Rows with one id are parts of one document: they aren't compared with each other, and
    each keeps its own result.  Null ids are never smaller or larger than another: such rows keep their words.  Columns
    named by carry come back in the struct `carried`; an empty table stays empty.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "substring")
    plain = texts(docs, id_col, text_col, *([F.struct(*carry).alias("carried")] if carry else [])).withColumn("mark", F.xxhash64("text"))
    repeated = repeated_windows(plain.select("doc_id", "text", "mark").where("doc_id IS NOT NULL"), scratch, width)
    return _apply(plain, repeated, width, texts_too)


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM h WHERE least < doc_id),
gl AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed,
  array_to_string(list_filter(words, lambda x, j: js IS NULL OR NOT list_contains(js, j)), ' ') AS kept FROM w LEFT JOIN gl USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
