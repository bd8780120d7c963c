"""Chat formatting by quotation linking.

A line's quote level is the number of '>' marks before its words.  Neighbouring lines of one level are a passage.  Quoted
passages, and in every message the passages it says itself (every run of its consecutive lines or sentences, so also
its paragraphs and its whole own text), are normalised and hashed; a quoted passage links to the message that said it
first.  Of a message's runs only those are hashed that are as long as some quoted passage.  Messages lose their quotes and gain a
parent, and conversations that quote each other are put in one thread, in which every parent stands before its replies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune
from .components import components

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_BLANK = re.compile(r"\s+")
_END = re.compile(r"""[.!?…]+["'”’)\]]*(?= )|[。！？]+["'”’」』）]*""")


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without its marks) of each line."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(text: str) -> str:
    return _BLANK.sub(" ", text).strip().casefold()


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text without quotes, quoted passages with their levels in order)."""
    own, passages = [], []
    before = 0
    for level, line in levels(text):
        if level == 0:
            own.append(line)
        elif level == before:
            passages[-1] = (level, passages[-1][1] + "\n" + line)
        else:
            passages.append((level, line))
        before = level
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text
    return kept, [(n, p) for n, p in passages if normal(p)]


def units(own: str) -> tuple[str, list[int], list[int]]:
    """(normalised text, where its lines and sentences start, where they end)."""
    lines = [x for x in map(normal, own.split("\n")) if x]
    starts, ends, at = [], [], 0
    for line in lines:
        cuts = [m.end() for m in _END.finditer(line) if m.end() < len(line)]
        starts += [at, *(at + c + (line[c] == " ") for c in cuts)]
        ends += [*(at + c for c in cuts), at + len(line)]
        at += len(line) + 1
    return " ".join(lines), starts, ends


def said(own: str, lengths: np.ndarray | None = None) -> set[str]:
    """What of a message others can quote, normalised: runs of its consecutive lines and sentences; only of these lengths (ascending), if given."""
    text, starts, ends = units(own)
    end, out = np.array(ends, np.int64), set()
    for k, start in enumerate(starts):
        size = end[k:] - start
        if lengths is not None:
            if not len(lengths):
                break
            size = size[: np.searchsorted(size, lengths[-1], "right")]
            size = size[lengths[np.minimum(np.searchsorted(lengths, size), len(lengths) - 1)] == size]
        out.update(text[start : start + n] for n in size.tolist())
    return out


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


RESULT = "conv_id long, turn long, role string, text string, n_quotes int, n_linked int, parent_conv long, parent_turn long, thread_id long"


def link_quotes(messages: DataFrame) -> DataFrame:
    """Per row of messages(conv_id, turn, role, text): its text without quotes and what it replies to.

    parent_conv, parent_turn: the message its first linked passage of level 1 (or of the least level linked) comes from:
    the first message of the same conversation to say it, if that is earlier, else the first of all, by (conv_id, turn),
    if that is before this one; null where nothing links.  thread_id: the least conv_id among conversations joined by
    links; ordered by (thread_id, conv_id, turn), every parent precedes its replies.  n_quotes counts quoted passages,
    n_linked those with a source.  Null texts count as empty; rows without conv_id or turn link with nothing; rows that
    repeat a (conv_id, turn) share its parent.  Passages without words are no quotes.
    """
    spark = messages.sparkSession
    tune(spark)
    scratch = Scratch(spark, "quotes")
    plain = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, t, k, level, _hash(normal(p)), len(normal(p))) for c, t, x in zip(*(v.to_pylist() for v in b.columns)) if ">" in x for k, (level, p) in enumerate(parse(x)[1])]
            if rows:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()))], names=["conv_id", "turn", "k", "level", "hash", "chars"])

    def sayings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, t, _hash(p)) for c, t, x in zip(*(v.to_pylist() for v in b.columns)) for p in said(parse(x)[0] if ">" in x else x, lengths)]
            if rows:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "turn", "hash"])

    keyed = plain.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text")
    quotes = scratch.table(keyed.mapInArrow(quoted, "conv_id long, turn long, k int, level int, hash string, chars int").distinct(), "quotes")
    # distinct lengths: no more numbers than the longest passage has characters
    lengths = np.array(sorted(r.chars for r in quotes.select("chars").distinct().collect()), np.int64)
    wanted = quotes.select("hash").distinct()
    # the first in each conversation, then the first of all: both combine before they move
    sources = keyed.mapInArrow(sayings, "conv_id long, turn long, hash string").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")).join(wanted, "hash", "left_semi")
    sources = scratch.table(sources, "sources")
    here = sources.select(F.col("hash").alias("h"), F.col("conv_id").alias("c"), F.col("turn").alias("here"))
    first = sources.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = quotes.join(here, (F.col("hash") == F.col("h")) & (F.col("conv_id") == F.col("c")) & (F.col("here") < F.col("turn")), "left").join(first, "hash", "left")
    source = F.when(F.col("here").isNotNull(), F.struct("conv_id", F.col("here").alias("turn"))).when(F.col("first") < F.struct("conv_id", "turn"), F.col("first"))
    found = found.select("conv_id", "turn", "k", "level", source.alias("source"))
    parents = scratch.table(found.groupBy("conv_id", "turn").agg(F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("level", "k"))).alias("parent"), F.count("source").cast("int").alias("n_linked")), "parents")
    scratch.drop("quotes", "sources")
    links = parents.where("parent.conv_id <> conv_id").select(F.col("conv_id").alias("a"), F.col("parent.conv_id").alias("b")).distinct()
    threads = components(links, scratch)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(x) if ">" in x else (x, []) for x in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int32())], names=["conv_id", "turn", "role", "text", "n_quotes"])

    own = plain.mapInArrow(strip, "conv_id long, turn long, role string, text string, n_quotes int")
    replies = parents.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "n_linked", "parent")
    out = own.join(replies, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").join(threads, F.col("conv_id") == F.col("id"), "left")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), F.coalesce("component_id", "conv_id").alias("thread_id"))


#: DuckDB SQL of link_quotes over conversations (small letters stand for folded ones, which differ in a few signs only).
SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
x AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
l AS (SELECT rid, i, line, regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1) AS marks FROM x),
v AS (SELECT rid, i, line, length(replace(replace(marks, ' ', ''), chr(9), '')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS rest FROM l),
g AS (SELECT *, sum(step) OVER (PARTITION BY rid ORDER BY i) AS grp FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS step FROM v)),
p AS (SELECT rid, grp, level, trim(regexp_replace(lower(string_agg(rest, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS words FROM g WHERE level > 0 GROUP BY rid, grp, level),
q AS (SELECT m.rid, conv_id, turn, level, words, row_number() OVER (PARTITION BY m.rid ORDER BY grp) - 1 AS k FROM p JOIN m USING (rid) WHERE words <> ''),
o AS (SELECT m.rid, m.conv_id, m.turn, m.role, CASE WHEN m.rid IN (SELECT rid FROM p) THEN coalesce((SELECT trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) FROM v WHERE v.rid = m.rid AND level = 0), '') ELSE m.text END AS text FROM m),
ol AS (SELECT rid, i, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
ou AS (SELECT rid, regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(29) ORDER BY i), '([.!?…]+["''”’)\]]*) ', '\1' || chr(31), 'g'), '([。！？]+["''”’」』）]*) ', '\1' || chr(31), 'g'), '([。！？]+["''”’」』）]*)([^\x1d\x1f"''”’」』）。！？])', '\1' || chr(30) || '\2', 'g') AS marked FROM ol WHERE line <> '' GROUP BY rid),
us AS (SELECT rid, regexp_extract_all(marked, '[^\x1d\x1e\x1f]+[\x1d\x1e\x1f]?') AS units FROM ou),
ui AS (SELECT rid, units, unnest(generate_series(1, len(units))) AS a FROM us WHERE EXISTS (SELECT 1 FROM q)),
ur AS (SELECT rid, units, a, unnest(generate_series(a, len(units))) AS b FROM ui),
r AS (SELECT rid, replace(replace(regexp_replace(array_to_string(units[a:b], ''), '[\x1d\x1e\x1f]$', ''), chr(30), ''), chr(31), ' ') AS run FROM ur),
s AS (SELECT m.conv_id, replace(run, chr(29), ' ') AS words, min(m.turn) AS turn FROM r JOIN m USING (rid) GROUP BY 1, 2),
f AS (SELECT words, min((conv_id, turn)) AS first FROM s GROUP BY words),
d AS (SELECT DISTINCT conv_id, turn, k, level, words FROM q WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT d.conv_id, d.turn, d.level, d.k, CASE WHEN s.turn IS NOT NULL THEN (d.conv_id, s.turn) WHEN f.first < (d.conv_id, d.turn) THEN f.first END AS source
  FROM d LEFT JOIN s ON s.words = d.words AND s.conv_id = d.conv_id AND s.turn < d.turn LEFT JOIN f ON f.words = d.words),
a AS (SELECT conv_id, turn, source[1] AS parent_conv, source[2] AS parent_turn, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, k) AS best FROM c WHERE source IS NOT NULL) WHERE best = 1),
e AS (SELECT conv_id AS x, parent_conv AS y FROM a WHERE parent_conv <> conv_id UNION SELECT parent_conv, conv_id FROM a WHERE parent_conv <> conv_id),
reach AS (SELECT x AS id, x AS via FROM e UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.via),
t AS (SELECT id, min(via) AS thread_id FROM reach GROUP BY id)
SELECT o.conv_id, o.turn, o.role, o.text, CAST(coalesce(nq.n, 0) AS INTEGER) AS n_quotes, CAST(coalesce(a.n, 0) AS INTEGER) AS n_linked, a.parent_conv, a.parent_turn, coalesce(t.thread_id, o.conv_id) AS thread_id
FROM o LEFT JOIN (SELECT rid, count(*) AS n FROM q GROUP BY rid) nq USING (rid) LEFT JOIN a ON a.conv_id = o.conv_id AND a.turn = o.turn LEFT JOIN t ON t.id = o.conv_id
"""
