import math
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import context_tree as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_base(rows):
    toks = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    count = Counter(x for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in ws)
    n, v = sum(count.values()), len(count)
    return {i: (len(ws), sum(count[x] > 0 for x in ws), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ws)) for i, ws in toks.items()}


class Node:
    def __init__(self):
        self.n, self.kids = Counter(), {}


def brute_scores(train, texts, share):
    """The recursion of context-tree weighting, one decision at a time."""
    total = sum(len(lower(t).encode()) + 1 for t in train)
    ctx = [Counter() for _ in range(C.DEPTH + 1)]
    rows = []
    for t in train:
        b = bytes([C.END] * C.DEPTH) + lower(t).encode() + bytes([C.END])
        for i in range(C.DEPTH, len(b)):
            for d in range(C.DEPTH + 1):
                ctx[d][b[i - d : i]] += 1
            rows.append((b[i - C.DEPTH : i], b[i]))
    kept = {c for d in range(1, C.DEPTH + 1) for c, n in ctx[d].items() if n >= max(1.0, total / share)} | {b""}

    def deepest(c):
        return max((c[len(c) - d :] for d in range(C.DEPTH + 1) if c[len(c) - d :] in kept), key=len)

    own = {}
    for c, s in rows:
        for k in range(8):
            own.setdefault((deepest(c), k, s >> (8 - k)), [0, 0])[s >> (7 - k) & 1] += 1
    kids = {c: [x for x in kept if len(x) == len(c) + 1 and x[1:] == c] for c in kept}

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def solve(c, k, top):
        rest = own.get((c, k, top), [0, 0])
        subs = [solve(x, k, top) for x in kids[c]]
        n = [rest[z] + sum(s[0][z] for s in subs) for z in (0, 1)]
        if not subs:
            return n, kt(n), 1.0
        below = kt(rest) + sum(s[1] for s in subs)
        w = np.logaddexp(kt(n), below) - math.log(2)
        return n, w, math.exp(kt(n) - math.log(2) - w)

    memo = {}

    def node(c, k, top):
        if (c, k, top) not in memo:
            memo[c, k, top] = solve(c, k, top)
        return memo[c, k, top]

    def p_one(c, k, top):
        at = deepest(c)
        p = None
        if kids[at]:
            r = own.get((at, k, top), [0, 0])
            p = (r[1] + 0.5) / (sum(r) + 1)
        for d in range(len(at), -1, -1):
            n, _, w = node(at[len(at) - d :] if d else b"", k, top)
            q = (n[1] + 0.5) / (sum(n) + 1)
            p = q if p is None else w * q + (1 - w) * p
        return p

    out = []
    for t in texts:
        b = bytes([C.END] * C.DEPTH) + lower(t).encode() + bytes([C.END])
        s = 0.0
        for i in range(C.DEPTH, len(b)):
            for k in range(8):
                p = p_one(b[i - C.DEPTH : i], k, b[i] >> (8 - k))
                s += math.log10(p if b[i] >> (7 - k) & 1 else 1 - p)
        out.append(s)
    return out


def test_scores_equal_the_recursion(spark, monkeypatch):
    texts = ["abracadabra", "banana band", "Éa abra", "", None, "bananas"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for share in (8, 1000):
        monkeypatch.setattr(C, "SHARE", share)
        got = {r["doc_id"]: r["score"] for r in C.score(df, df.where("doc_id < 4").select("text")).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], brute_scores(texts[:4], texts, share), rtol=1e-4)


def test_base_and_held_out_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    want = brute_base(texts.items())
    rows = C.query(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert abs(r["base_score"] - w[3]) < 1e-6 * abs(w[3])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(len(texts[r["doc_id"]].encode()) for r in held)
    assert bits < 3.5  # a byte of this text has over 4 bits without context


def test_chunks_and_rare_words_do_not_change_results(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in C.query(df).collect()}
    monkeypatch.setattr(C, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(C, "HOT_SHARE", 4)
    monkeypatch.setattr(C, "HELD", 1000)
    assert whole == {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in C.query(df).collect()}


def test_edge_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (None, "a b", 0), (4, "a " * 30000, 0)]
    out = C.query(spark.createDataFrame(rows, "doc_id bigint, text string, score int")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == [("1", 1), ("1", 1), ("2", 1), ("4", 30001), ("None", 3)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert C.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_rare_contexts_of_a_large_corpus_are_kept(spark):
    train, texts = ["ab " * 40000, "qzxjv qzxjv"], ["qzxjv", "b qzx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    learned = spark.createDataFrame([(t,) for t in train], "text string")
    got = {r["doc_id"]: r["score"] for r in C.score(df, learned).collect()}
    assert np.allclose([got[0], got[1]], brute_scores(train, texts, 1 << 60), rtol=1e-4)
