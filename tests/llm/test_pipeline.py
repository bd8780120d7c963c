"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bytebpe, classifier, minhash, queries, rules, substring

from ..conftest import SMALL
from .tables import awkward

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in pipeline.STAGES:
        rows = f(spark, docs, SMALL).collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema) if name != "packing" else None
    return {name: (a, b) for name, a, b in out}


def run_sql(rows, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in rows])
    return con.execute(sql).fetchall()


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "packing"]


def test_rules(stages):
    before, after = stages["quality_rules"]
    kept = {i for i, in run_sql(before, f"SELECT doc_id FROM ({rules.sql()}) WHERE kept")}
    assert 0 < len(after) < len(before) and sorted(after) == sorted(r for r in before if r.doc_id in kept)


def test_classifier(stages, spark):
    before, after = stages["quality_classifier"]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = classifier.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    keep = set()
    for r in before:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x = model.embed(*classifier.terms(data, np.array([0, len(data)])), 1)[0]
        near = sorted(((float(v @ x), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
        weight = [max(c, 0) ** 8 for c, _ in near]
        if sum(w * y for w, (_, y) in zip(weight, near)) >= 0.3 * sum(weight):
            keep.add(r.doc_id)
    assert {r.doc_id for r in after} == keep


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    kept = {i for i, in run_sql(before, f"SELECT doc_id FROM ({minhash.SQL}) WHERE kept")}
    assert len(after) < len(before) and sorted(after) == sorted(r for r in before if r.doc_id in kept)


def test_substring_dedup(stages):
    before, after = stages["substring_dedup"]
    sql = substring.SQL.replace("sha256(kept) AS kept_sha256", "kept")
    want = {i: (removed, kept) for i, _, removed, kept in run_sql(before, f"SELECT doc_id, n_words, n_removed, kept FROM ({sql})")}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id: r.text for r in after} == {i: kept if removed else texts[i] for i, (removed, kept) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after) and any(removed for removed, _ in want.values())


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    library = Tokenizer.from_file(bytebpe.default_path())
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == {r.doc_id for r in before}
    for r in before:
        ids, at = [*library.encode(r.text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_run_equals_its_stages(stages, spark):
    got = pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.start, r.doc_tokens) for r in got.collect() if not r.start) == sorted((r.doc_id, r.start, r.doc_tokens) for r in stages["packing"][1] if not r.start)
    assert got.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def test_stages_keep_extra_columns(spark):
    docs = awkward(spark).withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit("r"))
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    given = {tuple(r[c] for c in other) for r in docs.collect()}
    for name, f in pipeline.STAGES[:-1]:
        got = f(spark, docs, SMALL)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) <= 12 and {tuple(r[c] for c in other) for r in rows} <= given, name
    assert {r.doc_id for r in pipeline.packed(spark, docs, SMALL).collect()} == {r.doc_id for r in docs.collect()}


def test_run_on_empty_and_on_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, rows in (("none", docs.where("false")), ("twice", docs.unionAll(docs))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        if name == "none":
            assert got == []
        else:  # both rows of a document share their fate; what both hold is no repeat of another document
            assert got and all(r.n % 2 == 0 for r in got)


def test_registered():
    import __spark_entry__ as e

    for k in range(1, 11):
        assert [n for n in e.queries() if n.startswith(f"op{k}_")]
    assert "pipeline" in e.queries() and set(queries.SQL) <= set(e.oracle_sql())
