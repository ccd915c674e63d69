import hashlib
import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import piece_encoding as P

LIB = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
M = P.model(P.default_path())


def same(t):
    ids = M.encode(t)
    assert ids == LIB.encode(t, add_eos=True), t
    assert M.decode(ids) == LIB.decode(ids), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\taehtsinr.,'1<>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(t):
    same(t)


def test_spaces_and_long_words():
    for n in range(70):
        same(" " * n)
        same("a" + " " * n + "the")
    same("x" * 5000)
    same("".join(random.Random(1).choices("abcdefgh eé中", k=20000)))


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in P.query(df).collect():
        ids = LIB.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (None, "a", 3)]
    out = sorted(map(tuple, P.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()), key=str)
    assert out == sorted([(1, [2], ""), (1, [2], ""), (2, [2], ""), (None, [264, 2], "a")], key=str)
    assert P.query(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
