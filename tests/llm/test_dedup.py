import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from quirefold.llm import minhash, substring
from quirefold.llm.common import Scratch
from quirefold.llm.components import components

from ..conftest import SMALL, same_rows
from .tables import awkward, nothing, words


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(ids, pairs):
    parent = {i: i for i in ids}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(a, b):
    return bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)


def test_near_duplicates_by_sql(spark, duck):
    same_rows(minhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")), duck, minhash.SQL)


def test_near_duplicates_by_brute_force(spark):
    """Groups much larger than a small bucket, chains of copies of copies, exact copies, unrelated texts."""
    rng = random.Random(21)
    docs, base = [], words(rng, 120).split()
    for _ in range(90):  # near copies of one text
        x = list(base)
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = f"z{rng.randrange(10**6)}"
        docs.append(" ".join(x))
    chain = words(rng, 150).split()
    for k in range(25):  # each is near its neighbours only
        chain[(6 * k) % 150] = f"q{k}"
        docs.append(" ".join(chain))
    docs += [docs[3]] * 20 + [words(rng, rng.randint(1, 80)) for _ in range(60)] + ["same few words", "same few words", "", None]
    rng.shuffle(docs)
    sets = [shingles(d) for d in docs]
    want = groups(range(len(docs)), [(a, b) for a, b in combinations(range(len(docs)), 2) if near(sets[a], sets[b])])
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_pairs_on_one_template(spark):
    """Strangers share 170 of 200 shingles (0.74), pairs differ from each other by a few: all bands are hot."""
    rng = random.Random(8)
    template, docs = words(rng, 174), []
    for k in range(150):
        own = [f"o{k}x{j}" for j in range(30)]
        other = list(own)
        other[-rng.randint(18, 22) :] = [f"p{k}x{j}" for j in range(rng.randint(18, 22))]
        docs += [f"{template} {' '.join(own)}", f"{template} {' '.join(other)}"]
    rng.shuffle(docs)
    sets = [shingles(d) for d in docs]
    want = groups(range(len(docs)), [(a, b) for a, b in combinations(range(len(docs)), 2) if near(sets[a], sets[b])])
    assert len(set(want.values())) > 100
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_bands_of_texts_that_repeat_a_passage():
    """Jaccard similarity is 0.806, that of the weighted shingles about 0.4."""
    rng, n, found = np.random.default_rng(2), 200, 0
    for _ in range(n):
        h = rng.integers(1, 1 << 63, 124).astype(np.uint64)
        row = np.repeat([0, 1], [100, 124])
        bounds, keys = minhash.all_bands(row, np.concatenate([np.sort(h[:100]), h]), np.concatenate([np.ones(200, np.int64), np.full(24, 200)]), 2)
        found += bool(set(keys[: bounds[1]]) & set(keys[bounds[1] :]))
        plain = minhash.bands(minhash.sketches(row, np.concatenate([np.sort(h[:100]), h]), np.ones(224), 2))
        assert (np.sort(keys[: bounds[1]]) == np.sort(plain[0])).all()
    assert found >= 0.99 * n


def test_blocks_by_brute_force():
    rng = random.Random(4)
    sets = [{rng.choice([rng.randrange(60), rng.randrange(9000)]) for _ in range(80)} for _ in range(200)]
    row = np.array([k for k, s in enumerate(sets) for _ in s])
    got = minhash.common_counts(row, np.array([x for s in sets for x in s], np.uint64), np.arange(20, 90), 200)
    assert all(got[a - 20, b] == len(sets[a] & sets[b]) for a in range(20, 90) for b in range(200) if a != b)


def test_near_duplicates_of_awkward_rows(spark):
    got = minhash.near_duplicates(awkward(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[7].component_id == 1 and by[6].component_id == 5 and by[9].component_id == 8
    assert by[2].kept and by[3].kept and by[4].kept and by[None].kept and by[None].component_id is None
    assert minhash.near_duplicates(nothing(spark)).count() == 0


def removed(docs, width):
    first = {}
    for doc_id, text in docs:
        w = (text or "").encode().split()
        for k in range(len(w) - width + 1):
            first[tuple(w[k : k + width])] = min(doc_id, first.get(tuple(w[k : k + width]), doc_id))
    out = []
    for doc_id, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < doc_id:
                gone |= set(range(k, k + width))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_substrings_by_sql(spark, duck):
    same_rows(substring.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")), duck, substring.SQL)


@pytest.mark.parametrize("width, group, size", [(2, 2048, 1), (5, 2048, 2 << 20), (7, 6, 2000), (8, 1, 1), (9, 40, 500)])
def test_substrings_by_brute_force(spark, width, group, size, monkeypatch):
    """Prefixes in one part each, in several, and in as many as they have suffixes; some texts under two ids, some ids with two texts."""
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "TREE_BYTES", size)
    rng = random.Random(width)
    docs = [(k, rng.choice(["", " ", "\n"]).join([" ".join(rng.choice("abc") for _ in range(rng.randint(0, 25))), "  \t é "])) for k in range(60)] + [(60, None), (61, "")]
    got = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()
    assert sorted(map(tuple, got)) == sorted(removed(docs, width))


def test_substrings_of_one_id_with_other_texts(spark):
    t = words(random.Random(3), 80)
    got = substring.remove_repeats(spark.createDataFrame([(1, t), (2, t), (2, "quite other short text here")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 80, 0), (2, 5, 0), (2, 80, 80)]


def test_trees_with_equal_hashes_of_other_words(monkeypatch):
    """All words of one length share a hash: bytes decide."""
    monkeypatch.setattr(substring.W, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    texts = [b"a b c d", b"a b x d", b"a b c d", b"q b c d"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(5) * 7
    trees = substring.Trees(np.zeros(4, np.int64), np.full(4, 1), np.full(4, 1), data, offsets, 4)
    assert [x.tolist() for x in trees.runs(trees.marked(np.arange(4)))] == [[2], [0], [0]]


def test_substrings_of_awkward_rows(spark):
    got = substring.remove_repeats(awkward(spark), texts_too=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[6].n_removed == by[6].n_words == 30_000 and by[5].n_removed == 0 and by[2].n_words == by[3].n_words == by[4].n_words == 0
    assert by[6].kept == "" and by[4].kept == "   \n\t "
    assert substring.remove_repeats(nothing(spark)).count() == 0


def test_components_by_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    ids = {x for p in pairs for x in p}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "c")).collect()
    assert {r.id: r.component_id for r in got} == groups(ids, pairs)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "c")).count() == 0


def test_sql_agrees_with_brute_force():
    """The SQL itself, on a handful of texts."""
    con, rng = duckdb.connect(), random.Random(3)
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    base = [words(rng, 60) for _ in range(4)]
    docs = [(k, rng.choice(base) + " " + words(rng, rng.randint(0, 8))) for k in range(25)] + [(25, None)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({substring.SQL})").fetchall()) == sorted(removed(docs, 50))
    sets = [shingles(t) for _, t in docs]
    want = groups(range(26), [(a, b) for a, b in combinations(range(26), 2) if near(sets[a], sets[b])])
    assert dict(con.execute(f"SELECT doc_id, component_id FROM ({minhash.SQL})").fetchall()) == want
