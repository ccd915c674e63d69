import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_trees as T

C = T.counter(*T.defaults())


def full(text):
    return len(C.encoding.encode_ordinary(text))


TEXT = st.text(alphabet=st.one_of(st.sampled_from("  \n\tab'stll re12.,é"), st.characters(exclude_categories=["Cs"])), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 320), st.integers(0, 60), TEXT), max_size=5))
def test_edited_counts_equal_full_counts(text, edits):
    old, T.LEAF = T.LEAF, 3
    try:
        tree, plain = T.TokenTree(text, C), text
        assert tree.total == full(text)
        for pos, cut, new in edits:
            tree.edit(pos, cut, new)
            p = min(pos, len(plain))
            plain = plain[:p] + new + plain[p + cut :]
            assert tree.text == plain and tree.total == full(plain)
            assert tree.chars[1] == len(plain)
    finally:
        T.LEAF = old


def test_small_edits_reencode_little():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(50_000))
    tree = T.TokenTree(text, C)
    tree.encoded = 0
    tree.edit(len(text) // 2, 7, "xyz zyx")
    assert tree.encoded < 5 * T.LEAF and tree.total == full(tree.text)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    edits = df.select("doc_id", "text", T.derived_edits(df["text"], df["doc_id"]).alias("edits"))
    for r in T.apply_edits(T.build_trees(edits)).collect():
        assert r["n_tokens"] == full(texts[r["doc_id"]])
        assert r["n_tokens_edited"] == full(r["text"])
    assert T.query(df).count() == len(texts)


def test_edge_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "", [(0, 0, "ab")]), (None, "a b", [(None, None, None), (99, 5, " c")])]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, edits {T.EDITS}")
    out = sorted((str(r["doc_id"]), r["text"], r["n_tokens"], r["n_tokens_edited"]) for r in T.apply_edits(T.build_trees(df)).collect())
    assert out == [("1", "", 0, 0), ("1", "", 0, 0), ("2", "ab", 0, full("ab")), ("None", "a b c", 2, 3)]
    assert T.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
