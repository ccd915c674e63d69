import hashlib
import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P


def check(rows, sizes, lengths):
    """Bins hold disjoint pieces within a permitted length, and no piece is lost."""
    bins, got = {}, {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == sizes
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["start"])
        end = 0
        for r in pieces:
            assert r["start"] == end
            end += r["n_tokens"]
        assert {r["length"] for r in pieces} == {min(c for c in lengths if c >= end)}
    return bins


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in df.collect()}
    bins = check(P.query(df).collect(), sizes, P.LENGTHS)
    used = sum(p[0]["length"] for p in bins.values())
    assert sum(sizes.values()) / used > 0.97
    assert {tuple(r) for r in P.query(df).collect()} == {tuple(r) for r in P.query(df.repartition(7)).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 8), min_size=1, max_size=6))
def test_close_to_the_best_packing(sizes):
    lengths, of = (4, 8), lambda c: P.bin_cost(c, 1, 16)
    sizes.sort(reverse=True)
    where, start, final = P.pack_sizes(sizes, lengths, 1, 16)
    cost = sum(map(of, final))

    def total(groups):
        return sum(of(min((c for c in lengths if c >= g), default=1000)) for g in groups)

    best = min(total([sum(s for s, k in zip(sizes, at, strict=True) if k == b) for b in set(at)]) for at in itertools.product(range(len(sizes)), repeat=len(sizes)) if all(k <= i for i, k in enumerate(at)))
    assert best <= cost <= best * 1.7


def test_edge_rows(spark):
    rows = [(1, 20_000), (1, 20_000), (2, 0), (3, None), (None, 5), (4, 8192)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    check(P.pack(df).collect(), {1: 40_000, None: 5, 4: 8192}, P.LENGTHS)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in P.query(texts).collect()} == {1: 1, 2: 1, 3: 3}
    assert P.query(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def plain_pack(sizes, lengths, cost):
    """The rule read plainly: every open bin is looked at for each piece, and every later piece for each length."""
    bins, where = [], []
    for i, s in enumerate(sizes):
        open_ = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= s]
        if open_:
            k = min(open_)[1]
        else:

            def fill(c, s=s, i=i):
                free = c - s
                for x in sizes[i + 1 :]:  # falling
                    free -= x if x <= free else 0
                return c - free

            bins.append({"free": min((cost(c) / fill(c), c) for c in lengths if c >= s)[1], "used": 0})
            k = len(bins) - 1
        bins[k]["free"] -= s
        bins[k]["used"] += s
        where.append(k)
    return where, [min(c for c in lengths if c >= b["used"]) for b in bins]


def test_several_lengths_cost_less_than_one():
    rng = random.Random(8)
    for sizes in ([min(8192, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(3000)], [rng.randint(1, 8192) for _ in range(800)], [300] * 700 + [5000] * 40, [1025] * 500, [513, 1023] * 300):
        sizes.sort(reverse=True)
        lengths = P.pack_sizes(sizes)[2]
        total = sum(map(P.bin_cost, lengths))
        for one in P.LENGTHS:
            if one >= sizes[0]:
                assert total < sum(map(P.bin_cost, [one] * len(P.pack_sizes(sizes, (one,))[2])))
        # opening the largest length always, and downsizing, is the plainer rule
        assert total <= sum(P.bin_cost(min(c for c in P.LENGTHS if c >= n)) for n in contents(sizes, 8192))
    assert len(set(P.pack_sizes(sorted((min(8192, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(3000)), reverse=True))[2])) == len(P.LENGTHS)


def contents(sizes, one):
    where = P.pack_sizes(sizes, (one,))[0]
    out = {}
    for b, n in zip(where, sizes, strict=True):
        out[b] = out.get(b, 0) + n
    return out.values()


def test_query_equals_the_plain_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1) for r in docs.collect()]
    top = P.LENGTHS[-1]
    pieces = sorted(((min(top, n - k * top), i, k) for i, n in sizes for k in range((n - 1) // top + 1)), key=lambda x: (-x[0], x[1], x[2]))
    where, length = plain_pack([n for n, _, _ in pieces], P.LENGTHS, P.bin_cost)
    want = {(i, k): (n, b, length[b]) for (n, i, k), b in zip(pieces, where, strict=True)}
    got = {(r["doc_id"], r["piece"]): (r["n_tokens"], r["bin"], r["length"]) for r in P.query(docs).collect()}
    assert got == want


def test_sequences_hold_every_word(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, "a b  c"), (2, None), (3, long), (4, "x"), (4, "y"), (4, "y"), (None, "z\u2003z"), (None, None), (5, "\x0b q\n")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, key string, piece int")
    packed = P.pack(P.token_counts(docs)).transform(lambda d: P.written(d, "packed"))
    out = P.sequences(docs, packed).collect()
    assert all(len(r["words"]) == r["n_tokens"] <= r["length"] for r in out)
    words = [w for r in out for w in r["words"]]
    assert sorted(words) == sorted(["a", "b", "c", *long.split(), "x", "y", "y", "z\u2003z", "q", *[""] * 9])
    by = {(r["shard"], r["bin"]): r["words"] for r in out}
    texts = {i: t for i, t in rows if i in (1, 3, 5)}
    for r in P.query(docs).collect():
        text = " ".join(by[r["shard"], r["bin"]])
        assert r["sequence_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if r["doc_id"] in texts:
            whole = [*texts[r["doc_id"]].split(), ""][r["piece"] * 8192 : r["piece"] * 8192 + r["n_tokens"]]
            assert by[r["shard"], r["bin"]][r["start"] : r["start"] + r["n_tokens"]] == whole
    assert P.pack(P.token_counts(docs)).count() == P.query(docs).count() == len(rows) + 2


def test_rows_that_repeat_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 50)
    sizes = spark.range(1000).selectExpr("cast(null as bigint) doc_id", "5L n_tokens", "1 shard", "'x' bin")
    out = P.pack(sizes).groupBy("shard").count().collect()
    assert len(out) == 20 and sum(r["count"] for r in out) == 1000 and max(r["count"] for r in out) < 120
