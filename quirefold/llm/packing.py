"""Packing by dynamic programming: where to cut a stream of documents into sequences of at most `length` ids.

f(j) is the least cost of the ids before cut j.  A sequence from cut i to cut j costs what it is padded by, a fixed
`sequence_cost`, and the penalty of cut j: nothing at the end of a document, `sentence_penalty` at the end of a sentence,
`break_penalty` elsewhere (offered only where a sentence runs on).  Since the padding is length - (p_j - p_i), the best i
of the window is the least f(i) + p_i, kept by a monotone queue; sequences of a power of two need no padding and are
tried besides.  Order is kept: documents follow each other by doc_id.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytebpe import encoder
from .common import texts, tidy, tune

#: Ids that one run of the program looks at; what follows the last cut but one is carried into the next run.
RUN_IDS = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


@lru_cache(maxsize=2)
def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether its text ends a sentence, and whether it begins with white space."""
    code = encoder(path)
    words = [code.tokenizer.id_to_token(i) or "" for i in range(code.size)]
    ends = np.array([w[-1:] in (".", "!", "?", "Ċ") for w in words] + [False])
    begins = np.array([w[:1] in ("Ġ", "Ċ") for w in words] + [True])
    return ends, begins


def cuts(positions: np.ndarray, penalties: np.ndarray, length: int, sequence_cost: int) -> list[int]:
    """Indices of the best cuts; positions ascend from 0, and no two neighbours are further apart than length."""
    n = len(positions)
    pairs_j, pairs_i = [], []
    size = 1
    while size <= length:
        i = np.searchsorted(positions, positions - size)
        hit = np.flatnonzero((positions >= size) & (positions[i] == positions - size))
        pairs_j.append(hit)
        pairs_i.append(i[hit])
        size *= 2
    j_of, i_of = np.concatenate(pairs_j), np.concatenate(pairs_i)
    order = np.argsort(j_of, kind="stable")
    exact_j, exact_i = j_of[order].tolist() + [n], i_of[order].tolist()
    pos, pen = positions.tolist(), (penalties + sequence_cost).tolist()
    best, came = [0] * n, [0] * n
    queue, keys, e = deque([0]), deque([0]), 0  # candidates i of the window by ascending f(i) + p(i)
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - length:
            queue.popleft()
            keys.popleft()
        cost, source = keys[0] + length - p, queue[0]
        while exact_j[e] == j:
            if best[exact_i[e]] < cost:
                cost, source = best[exact_i[e]], exact_i[e]
            e += 1
        cost += pen[j]
        best[j], came[j] = cost, source
        key = cost + p
        while keys and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = came[j]
    return out[::-1]


def padded(n: int, length: int) -> int:
    """What a sequence of n ids is padded by: nothing at a power of two."""
    return 0 if n & (n - 1) == 0 else length - n


class Packer:
    """Takes documents in order and gives their pieces; holds RUN_IDS ids and the longest document at most."""

    def __init__(self, path: str, length: int, sentence_penalty: int, break_penalty: int, sequence_cost: int, spacing: int) -> None:
        self.code, self.length = encoder(path), length
        self.sentence, self.brk, self.cost, self.spacing = sentence_penalty, break_penalty, sequence_cost, spacing
        self.ends, self.begins = sentence_tables(path)
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, ids cut off before, all ids, ids
        self.held, self.sequence = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= RUN_IDS:
            yield from self.run(last=False)

    def candidates(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.append(flat[1:], 0)
        sentence = np.flatnonzero(self.ends[flat] & self.begins[after]) + 1
        at = np.unique(np.concatenate([[0], sentence, bounds]))
        gaps = np.diff(at)
        if len(wide := np.flatnonzero(gaps > self.spacing)):
            more = [np.arange(at[k] + self.spacing, at[k + 1], self.spacing) for k in wide]
            at = np.sort(np.concatenate([at, *more]))
        penalty = np.full(len(at), self.brk)
        penalty[np.searchsorted(at, sentence)] = self.sentence
        penalty[np.searchsorted(at, bounds)] = 0
        return at, penalty

    def run(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        flat = np.concatenate([d[3] for d in self.docs])
        bounds = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = self.candidates(flat, bounds)
        chosen = at[cuts(at, penalty, self.length, self.cost)].tolist()
        if not last:
            chosen = chosen[:-1]  # what the last sequence holds waits for more
        begin, d, within = 0, 0, 0
        for cut in chosen:
            offset = 0
            while begin < cut:
                doc_id, before, total, ids = self.docs[d]
                step = min(cut - begin, len(ids) - within)
                piece = ids[within : within + step]
                yield doc_id, before + within, step, zlib.crc32(piece.astype("<u4")), total, self.sequence, offset, 0
                begin, within, offset = begin + step, within + step, offset + step
                if within == len(ids):
                    d, within = d + 1, 0
            self.sequence += 1
        rest = self.docs[d:]
        if within:
            doc_id, before, total, ids = rest[0]
            rest[0] = doc_id, before + within, total, ids[within:]
        self.docs, self.held = rest, sum(len(x[3]) for x in rest)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, sentence_penalty: int = 4, break_penalty: int = 64, sequence_cost: int = 8, spacing: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of the sequence).

    Null and empty texts have the end id alone.  Rows with one doc_id follow each other by text; null ids come first.
    sequence_id ascends with doc_id but has gaps between tasks (its upper bits number the task).
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokenizer_path, length, sentence_penalty, break_penalty, sequence_cost, spacing)
        base, rows = TaskContext.get().partitionId() << 33, []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            ids, sizes = np.array(columns[5]), np.array(columns[2])
            edge = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            filled = np.add.reduceat(sizes, edge)
            pads = np.repeat([padded(int(x), length) for x in filled], np.diff(np.append(edge, len(ids))))
            columns[5], columns[7] = ids + base, pads
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at, to, ids, bounds in packer.code.runs(b.column(1), end_id):
                for k in range(at, to):
                    rows.extend(packer.add(doc_ids[k], ids[bounds[k - at] : bounds[k - at + 1]]))
                    if len(rows) >= 20_000:  # a run gives whole sequences only
                        yield table(rows)
                        rows = []
        rows.extend(packer.run(last=True))
        if rows:
            yield table(rows)

    return texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidy(run), PIECES)
