"""Quality rules as a short-circuit cascade.

The measures of a text come from vectorised passes over batches of texts.  A rule rejects by some of them; on a random
sample of all texts each rule's cost (seconds a text, with the measures it needs first) and its share of rejections are
estimated, and the cascade runs the rules in descending rejection per cost, each only on the texts that all rules before it kept.  The
order changes the work alone: a text is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import schema_with, slices, texts, tidy, tune

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_BLANK = " \t\n\v\f\r"
#: Expected number of texts in the sample that orders the rules, and its seed; results don't depend on them.
SAMPLE_ROWS, SEED = 2000, 20240304


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Texts:
    """Some texts as bytes with offsets; a measure is computed when first asked for, for the texts of `rows` alone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.have = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> Texts:
        """The texts of these rows, with the measures already known."""
        if len(rows) == len(self):
            return self
        sizes = np.diff(self.offsets)[rows]
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        out = Texts(np.concatenate(parts) if parts else self.data[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        out.have = {k: v[rows] for k, v in self.have.items() if isinstance(v, np.ndarray) and k in MEASURES}
        return out

    def get(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have[name] = MEASURES[name](self)
        return self.have[name]

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "bounds" not in self.have:
            self.have["bounds"] = W.word_bounds(self.data, self.offsets)
        return self.have["bounds"]


def _word_chars(t: Texts) -> np.ndarray:
    return _sums(~W.SPACE[t.data] & ((t.data & 0xC0) != 0x80), t.offsets)


def _dup_lines(t: Texts) -> np.ndarray:
    out = np.zeros(len(t), np.int64)
    for k in range(len(t)):
        text = t.data[t.offsets[k] : t.offsets[k + 1]].tobytes()
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            out[k] = len(lines) - len(set(lines))
    return out


def _repeat_words(t: Texts, k: int = 5) -> np.ndarray:
    starts, ends, first = t.bounds()
    h = W.windows(W.word_hashes(t.data, starts, ends), k)
    text, ok = W.owners(first, k, len(starts))
    at = np.flatnonzero(ok)
    key = h[at] ^ W.mix(text[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _sums(W.cover(at[twice], k, len(starts)), first)


def _capitals(t: Texts) -> np.ndarray:
    return _sums((t.data >= 65) & (t.data <= 90), t.offsets)


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: np.diff(t.bounds()[2]),
    "word_chars": _word_chars,
    "n_symbols": lambda t: _sums(_SYMBOL[t.data], t.offsets),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_capitals": _capitals,
    "n_lines": lambda t: _sums(t.data == 10, t.offsets) + 1,
}


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `rejects` of its measures is true; `sql` says the same over columns of those names."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    sql: str


#: The base rules of the contract, then what marks lists, tables, shouting and boilerplate.
RULES = (
    Rule("too_few_words", ("n_words",), lambda n: n < 10, "n_words < 10"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 4 * s > n, "4 * n_symbols > n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: (d >= 3) & (10 * d > 3 * n), "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", ("n_words", "word_chars"), lambda n, c: c > 20 * n, "word_chars > 20 * n_words"),
    Rule("short_words", ("n_words", "word_chars"), lambda n, c: c < 2 * n, "word_chars < 2 * n_words"),
    Rule("capitals", ("word_chars", "n_capitals"), lambda c, u: 10 * u > 5 * c, "10 * n_capitals > 5 * word_chars"),
)
BASE = ("too_few_words", "repeated_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) over a random sample of docs(one column): every text has the same chance.

    Executors measure the texts where they are; the driver gets three sums for each rule.  An empty table gives nothing.
    """
    n = docs.count()
    if not n:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seconds, rejected = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
            for _, _, data, offsets in slices(b.column(0)):
                for k, rule in enumerate(rules):
                    t = Texts(data, offsets)
                    began = time.perf_counter()
                    out = rule.rejects(*(t.get(m) for m in rule.needs))
                    seconds[k] += time.perf_counter() - began
                    rejected[k] += int(out.sum())
            yield pa.record_batch([pa.array(np.arange(len(rules), dtype=np.int32)), pa.array(seconds), pa.array(rejected), pa.array(np.full(len(rules), b.num_rows))], names=["rule", "seconds", "rejected", "texts"])

    sample = docs.where(F.rand(SEED) < rows / n).mapInArrow(tidy(run), "rule int, seconds double, rejected long, texts long")
    sums = sample.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "texts"))).where("texts > 0").collect()
    return [(rules[r.rule].name, r.seconds / r.texts, r.rejected / r.texts) for r in sums]


def ordered(rules: tuple[Rule, ...], figures: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, the best first; rules without figures (an empty table) keep their order at the end."""
    rank = {name: share / max(cost, 1e-9) for name, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: -rank.get(r.name, -1.0)))


def cascade(t: Texts, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(kept, index of the rule that rejected or -1): each rule sees only what the rules before it kept."""
    alive, by = np.arange(len(t)), np.full(len(t), -1)
    part = t
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        out = np.asarray(rule.rejects(*(part.get(m) for m in rule.needs)), bool)
        by[alive[out]] = k
        if out.any():
            alive, part = alive[~out], part.take(np.flatnonzero(~out))
    return by < 0, by


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with `kept` (boolean) and `rejected_by` (the cascade's rule, or null).

    Null texts count as empty and are rejected by too_few_words.  The given columns pass through unchanged, but for
    columns named kept or rejected_by, which are replaced.  An empty table stays empty.
    """
    tune(docs.sparkSession)
    docs = docs.drop("kept", "rejected_by")
    chain = ordered(rules, estimate(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")), rules))
    names, where = [r.name for r in chain], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, by = [], []
            for _, _, data, offsets in slices(b.column(where)):
                k, w = cascade(Texts(data, offsets), chain)
                kept.append(k)
                by.append(w)
            if b.num_rows:
                why = np.concatenate(by)
                yield pa.record_batch([*b.columns, pa.array(np.concatenate(kept)), pa.array([names[x] if x >= 0 else None for x in why], pa.string())], names=[*b.schema.names, "kept", "rejected_by"])

    return docs.mapInArrow(tidy(run), schema_with(docs, ("kept", "boolean"), ("rejected_by", "string")))


MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base measures, base_failed and the verdict of the cascade; the documents are not shuffled.

    The base measures are wanted of every text, so they come first; the cascade then saves what its other rules need
    (capitals, lines) for the texts that they are not asked about.  judge(), which wants no measures, skips costly rules
    in full.  Null texts count as empty (all measures 0, base_failed); repeated and null ids stay, row for row; an empty
    table stays empty.
    """
    tune(docs.sparkSession)
    docs = texts(docs, id_col, text_col)
    chain = ordered(rules, estimate(docs.select("text"), rules))
    base = [r for r in rules if r.name in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in slices(b.column(1)):
                t = Texts(data, offsets)
                columns = [t.get(m).astype(np.int64) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                failed = np.any([r.rejects(*(t.get(m) for m in r.needs)) for r in base], axis=0)
                kept, _ = cascade(t, chain)
                yield pa.record_batch([b.column(0).slice(at, to - at), *map(pa.array, columns), pa.array(failed), pa.array(kept & ~failed)], names=[c.split()[0] for c in MEASURED.split(", ")])

    return docs.mapInArrow(tidy(run), MEASURED)


def sql(table: str = "documents") -> str:
    """DuckDB SQL of measure()."""
    rejected = " OR ".join(f"({r.sql})" for r in RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
m AS (SELECT doc_id, len(words) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  len(string_split(text, chr(10))) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
g AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS j FROM k WHERE c >= 2) GROUP BY doc_id),
f AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_capitals, n_lines FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT ({rejected}) AS kept FROM f
"""
