import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import bpe, bytebpe, chunktable, packing, tokenfile
from quirefold.llm.common import Scratch

from ..conftest import SMALL
from .tables import awkward, nothing

PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "!", "1", "23", "é", "漢", " ", "\x1c", "<|endoftext|>", "<|startoftext|>", "\r", "-", "😀", "é", "\x00", "﻿", "ſ", "İ", " "]
PARTS += ["\v", "\f", "\x85", "\xa0", "#", "-x", "5a", "…", "²", "<|STARTOFTEXT|>"]


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = {}
    for m in (bytebpe, bpe):
        t = out[m] = Tokenizer.from_file(m.default_path())
        t.no_padding()
        t.no_truncation()
    return lambda module, text: out[module].encode(text or "", add_special_tokens=False).ids, out[bpe]


def texts_of(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_encoder_equals_the_library(library):
    ids, _ = library
    code = bytebpe.encoder(bytebpe.default_path())
    batch = mixed(1, 4000) + ["a b " * 300, " " * 50, "x" * 3000]
    assert [x.tolist() for x in code.encode(batch)] == [ids(bytebpe, t) for t in batch]


@pytest.mark.parametrize("room", ["full", "begun anew", "equal hashes"])
def test_encoders_with_a_poor_table(library, monkeypatch, room):
    ids, words = library
    monkeypatch.setattr(chunktable, "CHUNKS", 1_000_000 if room == "equal hashes" else 20)
    monkeypatch.setattr(chunktable, "LEAST_FOUND", 0.0 if room == "full" else 1.1)
    if room == "equal hashes":
        monkeypatch.setattr(chunktable.W, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    byte, word = bytebpe.ByteEncoder(bytebpe.default_path()), bpe.WordEncoder(bpe.default_path())
    for k in range(5):
        batch = mixed(100 + k, 60)
        assert [x.tolist() for x in byte.encode(batch)] == [ids(bytebpe, t) for t in batch]
        for (x, decoded), t in zip(word.encode(batch), batch):
            want = ids(bpe, t)
            assert np.frombuffer(x, word.dtype).tolist() == want and decoded == words.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("change", ["pre_tokenizer", "normalizer", "added"])
def test_other_tokenizer_files_get_whole_texts(tmp_path, change):
    spec = json.load(open(bytebpe.default_path(), encoding="utf-8"))
    if change == "pre_tokenizer":
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    elif change == "normalizer":
        spec["normalizer"] = {"type": "Replace", "pattern": {"String": "a B"}, "content": "b"}
    else:
        spec["added_tokens"].append({"id": 50257, "content": "B a", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    code = bytebpe.ByteEncoder(path)
    batch = [*mixed(11, 300), "a B a B a", "B a. a Ba B"]
    assert not code.chunked and [x.tolist() for x in code.encode(batch)] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_token_files(spark, library, source):
    ids, _ = library
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if source == "documents" else awkward(spark) if source == "awkward" else nothing(spark)
    folder = Scratch(spark, "t").path("f")
    manifest = tokenfile.write_token_files(docs, folder, bytebpe.default_path(), length=64, batch=4)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_token_files(spark, folder).collect())
    want, at = [], 0
    for doc_id, text in texts_of(docs):
        x = [*ids(bytebpe, text), 0]
        want.append((at, doc_id, len(x), crc(x)))
        at += len(x)
    assert got == want
    assert (manifest.agg(F.sum("n_ids")).first()[0] or 0) == at


def test_token_files_are_read_at_random(spark, library):
    ids, _ = library
    docs = spark.createDataFrame([(k, f"the {k} quick brown foxes, " * 9) for k in range(30)], "doc_id long, text string").coalesce(1)
    folder = Scratch(spark, "t").path("f")
    flat = [i for k in range(30) for i in [*ids(bytebpe, f"the {k} quick brown foxes, " * 9), 0]]
    at = 0
    for row in tokenfile.write_token_files(docs, folder, bytebpe.default_path(), length=32, batch=4).orderBy("shard").collect():
        shard = tokenfile.TokenShard(f"{folder}/shards/{row.tokens_file}")
        assert len(shard) == row.n_sequences
        for k in random.Random(0).sample(range(len(shard)), len(shard)):
            x, mask = shard[k]
            real = sum(mask.to_pylist())
            assert x[:real].tolist() == flat[at + 32 * k : at + 32 * k + real] and (real == 32 or k == len(shard) - 1)
        with pytest.raises(IndexError):
            shard[len(shard)]
        at += row.n_ids
    assert at == len(flat)


@pytest.mark.parametrize("source", ["documents", "awkward", "nothing"])
def test_packing(spark, library, source):
    ids, _ = library
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if source == "documents" else awkward(spark) if source == "awkward" else nothing(spark)
    rows = packing.pack(docs, bytebpe.default_path()).collect()
    want = defaultdict(list)
    for doc_id, text in texts_of(docs):
        want[doc_id].append([*ids(bytebpe, text), 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for doc_id, lists in want.items():
        assert sum(p.length for p in pieces[doc_id]) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for p in sorted(pieces[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(lists[0]) and p.ids_crc32 == crc(lists[0][at : at + p.length])
                at += p.length
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and {p.padding for p in s} == {packing.padded(at, 2048)}
        padding += packing.padded(at, 2048)
    if source == "documents":
        assert padding < 0.05 * sum(p.length for p in rows)


def test_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        length, cost = rng.choice([8, 16]), rng.randint(0, 3)
        steps = [rng.randint(1, length) for _ in range(rng.randint(1, 8))]
        p = np.concatenate([[0], np.cumsum(steps)])
        pen = np.array([0, *[rng.choice([0, 2, 9]) for _ in steps]])
        best = {0: 0}
        for j in range(1, len(p)):
            best[j] = min(best[i] + cost + int(pen[j]) + packing.padded(int(p[j] - p[i]), length) for i in range(j) if p[j] - p[i] <= length)
        chosen = [0, *packing.cuts(p, pen, length, cost)]
        got = sum(cost + int(pen[b]) + packing.padded(int(p[b] - p[a]), length) for a, b in zip(chosen, chosen[1:]))
        assert chosen[-1] == len(p) - 1 and got == best[len(p) - 1]


def test_word_bpe_equals_the_library(spark, library):
    ids, words = library
    rng = random.Random(9)
    odd = ["a" * 5000, "".join(rng.choice("abcdé漢'1!") for _ in range(20_000)), "".join(rng.choice("the ofan") for _ in range(3000)), "x" * 513 + "<|endoftext|>" + "y" * 700, "É" * 900]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*mixed(3, 2500), *odd])], "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).unionByName(awkward(spark).select("doc_id", "text"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, bpe.default_path(), digests=True).collect()}
    want = set()
    for doc_id, text in texts_of(docs):
        x = ids(bpe, text)
        want.add((doc_id, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.encode_texts(nothing(spark), bpe.default_path()).count() == 0


def test_joins_of_leaves(library):
    ids, _ = library
    rng = random.Random(4)
    tree = bpe.encoder(bpe.default_path()).tree
    for _ in range(150):
        text = "".join(rng.choice("theanding") for _ in range(rng.randint(1, 120)))
        assert tree.encode(text, leaf=rng.randint(2, 9), window=rng.randint(1, 3)) == ids(bpe, text)
