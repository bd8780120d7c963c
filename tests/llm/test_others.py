import base64
import hashlib
import random
from itertools import combinations

import numpy as np

from quirefold.llm import caps, quotes, warc
from quirefold.llm.common import Scratch

from ..conftest import SMALL, same_rows
from .test_dedup import groups


def archive(spark, rows, **more):
    folder = Scratch(spark, "w").path("a")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first string, _sha string")
    warc.write_archives(pages, folder, **more)
    return folder


def test_warc_by_sql(spark, duck):
    folder = Scratch(spark, "w").path("a")
    warc.write_archives(spark.read.parquet(f"{SMALL}/pages.parquet"), folder)
    same_rows(warc.read_archives(spark, folder), duck, warc.SQL)


def test_warc_of_awkward_rows(spark):
    rows = [(1, "http://A.example.com:80/x?q=1#f", "one"), (2, None, None), (3, "", ""), (4, "http://a.example.com/x?q=1", "one"), (5, "no url\nat all", "é" * 70_000), (6, "http://[bad", "\r\n\r\n"), (7, "https://b.org", "one"), (7, "https://b.org", "one"), (None, "http://n", "null id"), (None, "http://n", "one"), (8, 'http://c.org/a {"b": 1}\tc\x00', "odd"), (9, " {", "odd")]
    folder = archive(spark, [(*r, "x", "x") for r in rows], lines=2)
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(html or "")
        revisit = to is not None and i != to
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    index = warc.CaptureIndex(spark, folder)
    for i, url, html in rows:
        found = [(e["type"], index.fetch(e)) for e in index.captures(url) if e["page_id"] == i]
        assert ("response", (html or "").encode()) in found or ("revisit", b"") in found
    assert {e["page_id"] for e in index.captures("HTTP://a.EXAMPLE.com/x?q=1")} == {1, 4}
    assert index.captures("http://nowhere.example/") == []
    assert warc.read_archives(spark, archive(spark, [])).count() == 0


def test_warc_least_bytes(spark):
    folder = archive(spark, [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcd", "", ""), (4, "u", "abcd", "", "")], least_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, folder).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_captures_in_many_blocks(spark):
    rows = [(k, f"http://h{k % 7}.example.com/p{k % 30}", f"t{k}", "", "") for k in range(400)]
    index = warc.CaptureIndex(spark, archive(spark, rows, lines=3))
    assert sum(r.n_blocks for r in index.rows) > 20
    for url in {r[1] for r in rows}:
        assert sorted(e["page_id"] for e in index.captures(url)) == [r[0] for r in rows if r[1] == url]


def linked(rows):
    """Parents by looking at every earlier message; what link_quotes says in words."""
    said = sorted((c, t, quotes.said(quotes.parse(x or "")[0])) for c, t, x in rows)
    out = {}
    for c, t, x in rows:
        parent = None
        for level, k, p in sorted((level, k, quotes.normal(p)) for k, (level, p) in enumerate(quotes.parse(x or "")[1])):
            all_ = [(c2, t2) for c2, t2, s in said if p in s]
            here = [s for s in all_ if s[0] == c and s[1] < t]
            best = here[0] if here else all_[0] if all_ and all_[0] < (c, t) else None
            if best and parent is None:
                parent = best
        out[c, t] = parent
    return out


def test_quotes_by_brute_force(spark):
    rng = random.Random(12)
    say = [f"line {k} says so" for k in range(12)]
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 5)):
            lines = [rng.choice(["", "> ", "> > ", ">>", " > "]) + rng.choice([*say, "LINE 3  says so", ""]) for _ in range(rng.randint(0, 5))]
            rows.append((c, t, "\n".join(lines)))
    got = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    want = linked(rows)
    assert {(r.conv_id, r.turn): None if r.parent_conv is None else (r.parent_conv, r.parent_turn) for r in got} == want
    threads = groups({c for c, _, _ in rows}, [(k[0], p[0]) for k, p in want.items() if p])
    assert all(r.thread_id == threads[r.conv_id] for r in got)
    assert all((r.parent_conv, r.parent_turn) < (r.conv_id, r.turn) for r in got if r.parent_conv is not None)
    assert all(level == 0 or not line.strip() for r in got for level, line in quotes.levels(r.text) if r.n_quotes)


def conversations(rows):
    """The SQL's rows over (conv_id, turn, role, text)."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(quotes.SQL)
    names = [d[0] for d in got.description]
    return sorted((repr(tuple(r[names.index(c.split()[0])] for c in quotes.RESULT.split(", "))) for r in got.fetchall()))


def test_quotes_by_sql_on_nested_quotes(spark):
    """Quotes in quotes, partial ones, other white space and case, several in a message, across conversations."""
    rng, rows = random.Random(31), []
    say = ["One thing is so. Another is not! Why?", "short", "漢字。もう一つ！終わり", "It ends here.) And goes on", "a  b\tc", "No stop", "Why?", ""]
    for c in range(40):
        said = []
        for t in range(rng.randint(1, 6)):
            lines = []
            for _ in range(rng.randint(0, 4)):
                if said and rng.random() < 0.5:
                    part = rng.choice(said).split("\n")
                    lines += [">" * rng.randint(1, 2) + rng.choice(["", " "]) + rng.choice([x, x.upper(), f" {x} "]) for x in part[: rng.randint(1, 3)]]
                else:
                    lines.append(rng.choice(["", "", "> ", "> > "]) + rng.choice(say) + (f" {rng.randrange(9)}" if rng.random() < 0.4 else ""))
            text = "\n".join(lines)
            said.append(quotes.parse(text)[0])
            rows.append((c, t, rng.choice(["user", None]), text))
    rows += [(None, 1, "user", "> short"), (3, None, "user", "> short"), (50, 0, "user", None), rows[7], rows[7]]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("parent_conv IS NOT NULL AND n_quotes > 1").count() > 5
    assert sorted(repr(tuple(r)) for r in got.collect()) == conversations(rows)
    assert conversations([]) == []


def test_partial_quotes(spark):
    """Some lines of a paragraph, some of the paragraphs, one sentence, a message that began with an attribution."""
    one = "alpha one\nbeta two\ngamma three\ndelta four"
    two = "First paragraph here.\n\nSecond one, of two lines\nand more.\n\nThird."
    three = "Ann wrote:\n> something else\nI say no. Really? Yes! So be it."
    quoted = [(1, "beta two\ngamma three"), (2, "First paragraph here.\n\nSecond one, of\ntwo lines and more."), (3, "Really?"), (3, "I say no. Really? Yes!\nSo be it."), (3, "Ann wrote:\n> something else\nI say no. Really? Yes! So be it."), (None, "beta"), (None, "delta four\nalpha one")]
    rows = [(k, 1, "user", x) for k, x in enumerate((one, two, three), 1)]
    rows += [(10 + k, 1, "user", "\n".join(f"> {line}".rstrip() for line in x.split("\n")) + "\nmy answer " + str(k)) for k, (_, x) in enumerate(quoted)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id - 10: r.parent_conv for r in got if r.conv_id >= 10} == {k: to for k, (to, _) in enumerate(quoted)}


def test_quotes_of_awkward_rows(spark):
    rows = [(1, 1, "user", "first words"), (1, 2, None, "> First   WORDS\nyes"), (1, 2, None, "> first words\nyes"), (None, 1, "user", "> first words"), (2, None, "user", "> first words"), (3, 1, "user", None), (4, 1, "user", ">"), (5, 1, "user", ""), (6, 1, "user", "> " + "long " * 20_000)]
    got = quotes.link_quotes(spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, hash string, parent string")).collect()
    assert len(got) == len(rows)
    assert [(r.parent_conv, r.parent_turn, r.text) for r in got if (r.conv_id, r.turn) == (1, 2)] == [(1, 1, "yes")] * 2
    assert all(r.parent_conv is None for r in got if (r.conv_id, r.turn) != (1, 2))
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_vectors_by_sql(spark, duck):
    same_rows(caps.near_vectors(spark.read.parquet(f"{SMALL}/embeddings.parquet")), duck, caps.SQL)


def brute(vectors):
    good = [(k, np.array(v, float)) for k, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)]
    return [(i, j) for (i, a), (j, b) in combinations(good, 2) if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9]


def test_vectors_by_brute_force(spark):
    """A dense group of several chunks' worth of pairs, exact copies, and vectors near the limit."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(24)
    dense = [centre + 0.2 * rng.standard_normal(24) for _ in range(300)]
    edge = []
    for _ in range(150):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = rng.uniform(0.9, 0.97)
        edge += [a, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    rows = [(k, [float(y) for y in v]) for k, v in enumerate([*dense, *edge, *[dense[0]] * 40, *rng.standard_normal((200, 24))])]
    pairs = brute(rows)
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    found = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert (found <= degree).all() and found.sum() >= 0.97 * degree.sum()
    parts = groups(range(len(rows)), pairs)
    assert np.mean([r.component_id == parts[r.vec_id] for r in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(caps, "CHUNK", 16)
    monkeypatch.setattr(caps, "PAIRS", 7)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(k, [float(y) for y in centre + 0.1 * rng.standard_normal(16)]) for k in range(70)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    degree = np.bincount(np.array(brute(rows)).ravel(), minlength=70)
    assert sum(r.n_links for r in got) >= 0.97 * degree.sum() and all(r.n_links <= degree[r.vec_id] for r in got)


def test_vectors_of_two_components(spark):
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(np.random.default_rng(6).standard_normal((60, 2)))]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.95 * 2 * len(brute(rows))


def test_vectors_with_uneven_halves(spark):
    """All but a hundredth of the energy in the first components."""
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.91 * a + np.sqrt(1 - 0.91**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x = np.hstack([np.vstack([a, b]), 0.1 / np.sqrt(32) * np.tile(rng.standard_normal((1500, 32)), (2, 1))])
    got = caps.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.95 * ((u @ u.T >= 0.9).sum() - len(u))


def test_recall_of_caps_for_many_vectors():
    for n in (20_000, 200_000):
        assert caps.recall(caps.design(n, 64), 64, 0.905) >= 0.96


def test_groups_of_a_vector_hardly_grow_with_the_vectors():
    """The rows that are filed, sorted and compared: five times the vectors must not give each of them twice as many."""
    x = caps.units(np.random.default_rng(8).standard_normal((1000, 64)))
    filed = []
    for n in (10_000, 50_000, 250_000):
        design = caps.design(n, 64)
        row, found = caps.decode(x, design)
        filed.append(len(set(zip(row.tolist(), (found // design.words * design.ranges + found % design.words * design.ranges // design.words).tolist()))) / len(x))
    assert filed[0] < 8 and filed[1] < 13 and filed[2] < 20


def test_nearest_caps_are_the_largest_sums():
    for n, length in ((3000, 64), (5000, 7), (3000, 2)):
        design = caps.design(n, length)
        x = caps.units(np.random.default_rng(9).standard_normal((50, length)))
        row, found = caps.decode(x, design)
        y = x @ caps.rotation(length)
        one, two = design.books(y.shape[1])
        sums = (y[:, : y.shape[1] // 2] @ one.T)[:, :, None] + (y[:, y.shape[1] // 2 :] @ two.T)[:, None, :]
        for k, all_sums in enumerate(sums.reshape(len(x), -1)):
            assert found[row == k].tolist() == sorted(np.argsort(-all_sums)[: design.nearest].tolist())


def test_links_of_vectors_around_one_direction(spark):
    """Vectors that all point much the same way, more than a chunk, with few near pairs: caps that hold one hold many, or none."""
    rng = np.random.default_rng(10)
    noise = rng.standard_normal((1400, 64))
    near = np.vstack([noise, 0.6 * noise + 0.8 * rng.standard_normal((1400, 64))])
    x = rng.standard_normal(64) * 2 + near
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = caps.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    links = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert true.sum() > 1000 and (links <= true.sum(1)).all() and links.sum() >= 0.96 * true.sum()


def test_vectors_of_one_chunk_lose_no_link(spark):
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, 700, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    x = np.vstack([a, 0.9001 * a + np.sqrt(1 - 0.9001**2) * b / np.linalg.norm(b, axis=1, keepdims=True)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    degree = np.bincount(np.array(brute(rows)).ravel(), minlength=len(rows))
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == degree.tolist()


def test_vectors_of_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-300, 2e-300]), (11, [1e300, 2e300]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (None, [1.0, 2.0]), (14, [5.0])]
    got = caps.near_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, id int, key string")).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[k].n_links == 0 and by[k].kept for k in (1, 2, 3, 4, 5, 6, 9, 14)) and by[None].component_id is None and by[None].n_links == 0
    assert {by[k].component_id for k in (7, 8, 10, 11)} == {7} and by[13].component_id in (7, 12)
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
