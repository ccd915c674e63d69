import hashlib
import random

import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import trie_encoding as T

LIB = tokenizers.Tokenizer.from_file(T.default_path())
M = T.model(T.default_path())


def same(t):
    ids = M.encode(t)
    assert ids == LIB.encode(t, add_special_tokens=False).ids, t
    assert M.decode(ids) == LIB.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\taehtsinr.,'1<|> ֈ࢏\U00010940"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(t):
    same(t)


def test_special_tokens_and_spaces():
    for t in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y  ", "  <|endoftext|>  \n", "<|endoftext|", "it's  we'll\n\n\n x", "　  a\u0085b"):
        same(t)
    for n in range(40):
        same(" " * n + "the" + "\n" * n)


def test_long_words():
    same("a" * 5000)
    same("x" * 255 + " " + "y" * 257 + " " + "é" * 200)
    same("".join(random.Random(1).choices("abcdefghé中", k=20_000)))


def test_shared_prefixes_are_encoded_once(monkeypatch):
    m = T.TrieModel(T.default_path())
    calls = []
    monkeypatch.setattr(m, "last_token", lambda path, *rest, f=m.last_token: calls.append(path) or f(path, *rest))
    words = [" nation", " national", " nations", " nationality", " native"]
    out = m.spread(words)
    assert sorted(calls) == sorted({w.encode()[:k] for w in words for k in range(1, len(w) + 1)})
    for w in words:
        ids = LIB.encode(w, add_special_tokens=False).ids
        assert out[w] == (b"".join(b",%d" % i for i in ids), len(ids), w.encode())


def test_compatible_tokens_are_what_merging_leaves():
    rng = random.Random(5)
    ids = sorted(M.id.values())
    for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(20_000)):
        assert M.compatible(a, b) == (M.merged(M.token[a] + M.token[b]) == [M.token[a], M.token[b]])
    assert len(M.id) == 50_256


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    monkeypatch.setattr(T, "TRIE_WORDS", 2)
    m = T.TrieModel(T.default_path())
    for t in ("one two three four", "five six seven one two eight nine ten", "one"):
        assert m.encode(t) == LIB.encode(t, add_special_tokens=False).ids


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = T.query(df).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIB.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, 1, "p"), (1, None, 1, "p"), (2, "", 2, "q"), (None, "a b", 3, None), (3, "word " * 200_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, decoded string")
    out = {(r["doc_id"], r["decoded"]): r["ids"] for r in T.encode(df).collect()}
    assert out[1, ""] == out[2, ""] == [] and out[None, "a b"] == [64, 275] and len(out[3, "word " * 200_000]) == 200_001
    assert T.encode(df).count() == 5
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, T.query(df.where("doc_id < 3")).collect())) == [(1, 0, nothing, nothing)] * 2 + [(2, 0, nothing, nothing)]
    assert T.query(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
