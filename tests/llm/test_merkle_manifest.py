import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import merkle_manifest as M

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """The contract, read plainly; rows are (doc_id, source, lang, n_chars, text)."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % 8 : i - i % 8 + 8]
            out.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        return out

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0], H(*map(enc, r)), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in langs[lang]])
    top = tree([trees[x][-1][0] for x in order])
    root = top[-1][0] if rows else None
    out = []
    for k, lang in enumerate(order):
        for i, (doc, leaf, r) in enumerate(langs[lang]):
            steps = path(trees[lang], i) + path(top, k)
            text = r[4]
            if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = H(*map(enc, (*r[:4], text)))
            for left, right in steps:
                folded = H(*left, folded, *right)
            out.append((doc, leaf, trees[lang][-1][0], root, H(*(x for left, right in steps for x in left + right)), folded, folded == root))
    return sorted(out, key=repr)


def run(df, **options):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in M.query(df, **options).collect()), key=repr)


def test_states_are_the_hash():
    rng = np.random.RandomState(1)
    for n in (1, 2, 7, 8, 9, 64, 65, 100, 513):
        leaves = [hashlib.sha256(bytes([k % 256, k // 256])).hexdigest() for k in range(n)]
        levels = M.depth(n, M.LEVELS)
        digests, states = M.build(M.from_hex(leaves), levels)
        want = [leaves]
        for _ in range(levels):
            want.append([H(*want[-1][k : k + 8]) for k in range(0, len(want[-1]), 8)])
        assert [[x.decode() for x in M.as_hex(d)] for d in digests] == want and [len(s) for s in states] == [len(w) for w in want[:-1]]
        i = int(rng.randint(n))
        for level in range(levels):  # a resumed state is the hash of the left siblings and what follows
            slot, kids = i % 8, want[level][i - i % 8 : i - i % 8 + 8]
            new = hashlib.sha256(b"new").hexdigest()
            got = M.resume(states[level][[i]], np.array([slot]), np.array([len(kids)]), M.from_hex([new]), M.as_words(digests[level]), np.array([i + 1]))
            assert M.as_hex(got)[0].decode() == H(*kids[:slot], new, *kids[slot + 1 :])
            i //= 8


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_whole_table_equals_brute_force_and_sql(spark, sf_dir, docs):
    got = run(docs)
    assert got == brute(rows_of(docs)) and {r[6] for r in got} == {True, False}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(db.sql(M.SQL).fetchall(), key=repr) == got


def test_more_rounds_of_small_blocks(docs):
    assert run(docs, levels=1) == brute(rows_of(docs))


def test_edge_rows(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, key string, pos int, digest string"
    rows = [(1, None, "b", None, None), (1, None, "b", None, None), (2, "s", None, 0, ""), (None, "s", None, 3, "ABC"), (None, "t", "é", 3, "ABC"), (3, "s", "z", 9, "Ab" * 400_000), (4, "s", "Z", 1, "x")]
    rows += [(k, "s", f"l{k % 70}", 1, "Text É %d" % k) for k in range(5, 300)]
    df = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], schema)
    assert run(df) == brute(rows)
    assert run(df.where("doc_id = 4")) == brute([rows[6]])
    assert M.query(df.limit(0)).collect() == []
