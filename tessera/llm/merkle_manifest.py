"""A Merkle manifest of a dataset whose parents retain hash states.

A parent is the SHA-256 of its children's digests as hex text, so each child is one block of
the hash: the state after the children left of a slot is eight words. Every parent retains a
copy of the state before each of its slots. To fold a changed row up to the root, the state
of its slot is resumed with the new digest and the siblings to the right alone; those to the
left are never hashed again.

Rows are numbered within their group (here: a language) by a range partitioning and offsets
of its partitions. A block of 8^4 consecutive nodes is four levels of the tree and one row
of a table; the tops of the blocks are the nodes of the next round, so a tree of n rows takes
log(n) / log(4096) rounds, and no task holds more than a block. The groups' roots are
the leaves of one more tree of the same form.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a parent; levels of a block, whose nodes are FAN**LEVELS.
FAN, LEVELS = 8, 4

_ASCII = "".join(map(chr, range(65, 91)))


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    """The integer part of the cube root."""
    x = 1 << -(-n.bit_length() // 3)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


#: The hash's constants: fractions of square and cube roots of the first primes, 32 bits each.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.array([list(b"%02x" % b) for b in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one block (n, 16) each; both of 32-bit words. One row serves all rows of the other."""
    w = list(np.ascontiguousarray(block.T))
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    first = list(np.ascontiguousarray(state.T))
    a, b, c, d, e, f, g, h = first
    for i in range(64):
        x = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        y = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = x + y, a, b, c, d + x, e, f, g
    return np.stack([p + q for p, q in zip(first, (a, b, c, d, e, f, g, h), strict=True)], axis=1)


def as_words(digests: np.ndarray) -> np.ndarray:
    """The blocks (n, 16) of the digests' (n, 8) hex texts."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(-1, 32)
    return _HEX[raw].reshape(-1, 64).view(">u4").astype(np.uint32)


def as_hex(digests: np.ndarray) -> list[bytes]:
    text = _HEX[np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(-1, 32)].tobytes()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def from_hex(texts: list[str] | list[bytes]) -> np.ndarray:
    raw = b"".join(bytes.fromhex(t if isinstance(t, str) else t.decode()) for t in texts)
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def _padding(children: np.ndarray) -> np.ndarray:
    """The last blocks of messages of so many blocks."""
    out = np.zeros((len(children), 16), np.uint32)
    out[:, 0], out[:, 15] = 1 << 31, children * 512
    return out


def _sizes(n: int, levels: int) -> list[int]:
    """Nodes on each level of a block of ``n`` nodes, from the lowest to the top."""
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // FAN))
    return out


def depth(total: int, most: int) -> int:
    """Levels above a block's nodes, at most ``most``, if the tree's round has ``total`` of them."""
    levels = 0
    while levels < most and FAN**levels < total:
        levels += 1
    return levels


def build(digests: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(each level's digests, each level's retained states but the top's) over ``digests`` (n, 8).

    A level's states are those before each of its nodes, in their parents.
    """
    all_digests, all_states = [digests], []
    for _ in range(levels):
        below = all_digests[-1]
        n = len(below)
        state, before, words = np.tile(START, (-(-n // FAN), 1)), np.empty_like(below), as_words(below)
        for slot in range(min(FAN, n)):
            own = np.arange(slot, n, FAN)
            before[own] = state[: len(own)]
            state[: len(own)] = compress(state[: len(own)], words[own])
        children = np.full(len(state), FAN)
        children[-1] = n - FAN * (len(state) - 1)
        all_states.append(before)
        all_digests.append(compress(state, _padding(children)))
    return all_digests, all_states


def resume(state: np.ndarray, slot: np.ndarray, children: np.ndarray, new: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parents' digests with ``new`` (n, 8) in ``slot``: from the retained state, with right siblings only.

    ``right``: words of siblings, of which a row's own begin at ``at``.
    """
    d = compress(state, as_words(new))
    for k in range(FAN - 1):
        more = np.flatnonzero(slot + 1 + k < children)
        if not len(more):
            break
        d[more] = compress(d[more], right[at[more] + k])
    return compress(d, _padding(children))


def _pack(levels: list[np.ndarray]) -> bytes:
    return b"".join(x.astype(">u4").tobytes() for x in levels)


def _unpack(raw: bytes, sizes: list[int]) -> list[np.ndarray]:
    whole = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)
    return np.split(whole, np.cumsum(sizes)[:-1]) if sizes else []


_BLOCKS = "key string, block bigint, total bigint, n int, levels int, digests binary, states binary, top string"
_PATH = "slots array<int>, states array<binary>, siblings array<string>"


def _build_block(table: pa.Table, most: int) -> pa.Table:
    """One row of a block of ``most`` levels from its nodes (key, block, pos, total, digest)."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    levels = depth(table.column("total")[0].as_py(), most)
    digests, states = build(from_hex(table.column("digest").take(pa.array(order)).to_pylist()), levels)
    return pa.table({
        "key": table.column("key")[:1], "block": table.column("block")[:1], "total": table.column("total")[:1], "n": pa.array([len(order)], pa.int32()), "levels": pa.array([levels], pa.int32()),
        "digests": pa.array([_pack(digests)], pa.binary()), "states": pa.array([_pack(states)], pa.binary()), "top": pa.array([as_hex(digests[-1])[0].decode()]),
    })


class _Block:
    """A block's levels, and the path of its top, from their rows."""

    def __init__(self, row: dict):
        sizes = _sizes(row["n"], row["levels"])
        self.sizes = sizes
        self.digests, self.states = _unpack(row["digests"], sizes), _unpack(row["states"], sizes[:-1])
        self.slots, self.above, self.siblings = row["slots"], row["above"], [s.encode() for s in row["siblings"]]

    def place(self, level: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, slot, children of its parent) on a level, of the block's nodes ``pos``."""
        node = pos // FAN**level
        slot = node % FAN
        return node, slot, np.minimum(FAN, self.sizes[level] - (node - slot))

    def fold(self, pos: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The root's digest for each of the nodes ``pos`` with ``new`` in its place."""
        for level in range(len(self.states)):
            node, slot, children = self.place(level, pos)
            new = resume(self.states[level][node], slot, children, new, as_words(self.digests[level]), node + 1)
        for slot, state, siblings in zip(self.slots, self.above, self.siblings, strict=True):
            right = siblings[64 * slot :]
            words = as_words(from_hex([right])) if right else np.zeros((0, 16), np.uint32)
            n, same = len(new), np.zeros(len(new), np.int64)
            new = resume(np.tile(np.frombuffer(state, ">u4").astype(np.uint32), (n, 1)), same + slot, same + len(siblings) // 64 + 1, new, words, same)
        return new

    def proofs(self) -> list[list[bytes]]:
        """For each level, bottom up, each node's siblings on that level and above, as hex text."""
        out = [[b"".join(self.siblings)]]
        for level in reversed(range(len(self.states))):
            text = as_hex(self.digests[level])
            runs = [text[k : k + FAN] for k in range(0, len(text), FAN)]
            out.append([b"".join(x for j, x in enumerate(run) if j != i) + out[-1][k] for k, run in enumerate(runs) for i in range(len(run))])
        return out[::-1]

    def steps(self, pos: int) -> tuple[list[int], list[bytes], list[str]]:
        """The path of a node: slots, retained states and siblings, up to the root."""
        slots, states, siblings = [], [], []
        for level in range(len(self.states)):
            node = pos // FAN**level
            slot = node % FAN
            run = as_hex(self.digests[level][node - slot : node - slot + FAN])
            slots.append(slot)
            states.append(self.states[level][node].astype(">u4").tobytes())
            siblings.append(b"".join(run[:slot] + run[slot + 1 :]).decode())
        return slots + self.slots, states + self.above, siblings + [s.decode() for s in self.siblings]


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (key, ...) with ``pos``, the place within the key by ``order``, and ``total``, the key's rows.

    Partitions are ranges; a row's place is its partition's offset and its place there. Rows
    that tie are alike, so any order of theirs is right.
    """
    sorted_ = written(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    own = F.shiftright("_at", 33).alias("_part")
    of_key = Window.partitionBy("key")
    parts = sorted_.groupBy("key", own).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.select("key", "_part", (F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_key).alias("total"))
    return sorted_.withColumn("_part", own).join(parts, ["key", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("pos", F.pmod("pos", F.lit(size)))


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The rounds' blocks over ``nodes`` (key, pos, total, digest); the last block of each key has its root as top."""
    rounds, size = [], FAN**levels
    while True:
        own = _blocked(nodes, size).select("key", "block", "pos", "total", "digest").groupBy("key", "block")
        blocks = written(own.applyInArrow(lambda table: _build_block(table, levels), _BLOCKS), "blocks")
        rounds.append(blocks)
        more = blocks.where(F.col("total") > size)
        if more.limit(1).count() == 0:
            return rounds
        nodes = more.select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("digest"))


def _tops(rounds: list[DataFrame], size: int) -> DataFrame:
    """(key, digest): each tree's root."""
    out = None
    for blocks in rounds:
        own = blocks.where(F.col("total") <= size).select("key", F.col("top").alias("digest"))
        out = own if out is None else out.unionByName(own)
    return out


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the paths of their tops: ``above`` is (key, block, label, slots, states, siblings)."""
    return blocks.join(above.withColumnRenamed("states", "above"), ["key", "block"])


def _paths(nodes: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(key, pos, label, slots, states, siblings) of ``nodes`` (key, pos), in blocks with the paths of their tops."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0] if len(right) else None
        at = left.column("pos").to_pylist() if row else []
        slots, states, siblings = zip(*map(_Block(row).steps, at), strict=True) if at else ((), (), ())
        pos = [size * row["block"] + p for p in at] if row else []
        return pa.table({
            "key": pa.array([row["key"]] * len(at) if row else [], pa.string()), "pos": pa.array(pos, pa.int64()), "label": pa.array([row["label"]] * len(at) if row else [], pa.string()),
            "slots": pa.array(list(slots), pa.list_(pa.int32())), "states": pa.array(list(states), pa.list_(pa.binary())), "siblings": pa.array(list(siblings), pa.list_(pa.string())),
        })

    return _blocked(nodes.select("key", "pos"), size).groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(run, f"key string, pos bigint, label string, {_PATH}")


def _descend(rounds: list[DataFrame], roots: DataFrame, size: int) -> DataFrame:
    """The first round's blocks with the paths of their tops, whose trees' roots have the paths ``roots`` (key, label, ...)."""
    path = ["label", "slots", "states", "siblings"]
    lower = None
    for k in reversed(range(len(rounds))):
        own = rounds[k].where(F.col("total") <= size).select("key", "block").join(roots, "key").select("key", "block", *path)
        blocks = _with_paths(rounds[k], own if lower is None else own.unionByName(lower))
        if k == 0:
            return blocks
        nodes = rounds[k - 1].where(F.col("total") > size).select("key", F.col("block").alias("pos"))
        lower = written(_paths(nodes, blocks, size).select("key", F.col("pos").alias("block"), *path), "paths")
    raise AssertionError("a tree has a round")


@dataclass
class Manifest:
    """``rows``: the leaves with their places; ``rounds``: the blocks of the groups' trees, each with digests and retained states; ``subroots``: their roots, in order; ``upper``: the rounds over these; ``root``; ``size``: nodes of a block."""

    rows: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None
    size: int = FAN**LEVELS


def manifest(leaves: DataFrame, *order: str, levels: int = LEVELS) -> Manifest:
    """The manifest of ``leaves`` (key, digest, ...): a tree a key, in ``order``, and a tree over the keys' roots."""
    size = FAN**levels
    rows = _ranked(leaves, *order, "digest")
    rounds = _climb(rows, levels)
    subroots = _ranked(_tops(rounds, size).select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), "group")
    upper = _climb(subroots, levels)
    root = _tops(upper, size).collect()  # one row, or none of an empty table
    return Manifest(rows, rounds, subroots, upper, root[0]["digest"] if root else None, size)


def fold(m: Manifest, *keep: str, replaced: str) -> DataFrame:
    """(*keep, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of the manifest.

    ``replaced`` is the column with the digest that stands for the row's own: it is folded up
    by the retained states, and verified if that gives the root.
    """
    top = m.subroots.select("key", "pos", "group", F.col("digest").alias("subroot"))
    here = _descend(m.upper, m.upper[0].select("key").distinct().select("key", F.lit("").alias("label"), F.array().cast("array<int>").alias("slots"), F.array().cast("array<binary>").alias("states"), F.array().cast("array<string>").alias("siblings")), m.size)
    roots = written(_paths(top, here, m.size).join(top, ["key", "pos"]).select(F.col("group").alias("key"), F.col("subroot").alias("label"), "slots", "states", "siblings"), "roots")
    blocks = _descend(m.rounds, roots, m.size)
    root = m.root or ""
    kinds = dict(m.rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(right.to_pylist()[0])
        pos = left.column("pos").to_numpy().astype(np.int64)
        folded = [x.decode() for x in as_hex(b.fold(pos, from_hex(left.column("_new").to_pylist())))]
        if b.states:
            text, upper = as_hex(b.digests[0]), b.proofs()[1]
            proof = [hashlib.sha256(b"".join(text[p - p % FAN : p] + text[p + 1 : p - p % FAN + FAN]) + upper[p // FAN]).hexdigest() for p in pos.tolist()]
        else:
            proof = [hashlib.sha256(b.proofs()[0][0]).hexdigest()] * len(pos)
        n = len(pos)
        return pa.table({
            **{c: left.column(c) for c in keep}, "leaf": left.column("_leaf"), "subroot": pa.array(right.column("label").to_pylist() * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
        })

    rows = _blocked(m.rows, m.size).select("key", "block", "pos", F.col("digest").alias("_leaf"), F.col(replaced).alias("_new"), *keep)
    return rows.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(run, schema)


def digest_of(*fields: Column) -> Column:
    """The SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, ``:`` and its text."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, tampered): each row's leaf, and the leaf after tampering.

    ``key`` is ``0`` for a null language, else ``1`` and the language, so that null comes first.
    Where 3 divides the CRC of doc_id, tampering lower-cases the text's A-Z.
    """
    own = lambda text: digest_of(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("bigint"), text)
    text = F.col("text").cast("string")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string")) % 3 == 0, F.lit(False))
    lang = F.col("lang").cast("string")
    return docs.select(
        F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), own(text).alias("digest"),
        F.when(changed, own(F.translate(text, _ASCII, _ASCII.lower()))).alias("tampered"),
    )


def query(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    Rows of a language are in order of doc_id, null first, and of their leaves where ids tie;
    rows that repeat are leaves each. A table without rows has no result. Columns beside
    doc_id, source, lang, n_chars and text are not read.
    """
    m = manifest(written(leaves(docs), "leaves"), "doc_id", levels=levels)
    m.rows = m.rows.withColumn("new", F.coalesce("tampered", "digest"))
    return fold(m, "doc_id", replaced="new")


def sql(levels: int = 8) -> str:
    """The query in DuckDB's SQL, for trees of at most so many levels.

    A level's nodes with ``siblings`` are joined to their parents; ``crc`` is the bitwise CRC-32.
    """
    enc = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: f"sha256({' || '.join([*map(enc, ('doc_id', 'source', 'lang', 'n_chars')), enc(text)])})"
    lower = f"translate(text, '{_ASCII}', '{_ASCII.lower()}')"
    bit = "case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)), lambda s, c: list_reduce(list_prepend(xor(s, c), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: {bit})), 4294967295)"
    out = [f"with lv as materialized (select doc_id, lang, {row('text')} leaf, case when {crc} % 3 = 0 then {row(lower)} else {row('text')} end new from documents)"]

    def tree(name: str, first: str) -> list[str]:
        """Levels name0.. of (lang, pos, digest, ...); a level of one node stays."""
        made = [f"{name}0 as materialized ({first})"]
        for k in range(levels):
            made.append(f"{name}{k + 1} as materialized (select lang, pos // 8 pos, case when max(n) = 1 then min(digest) else sha256(string_agg(digest, '' order by pos)) end digest from (select *, count(*) over (partition by lang) n from {name}{k}) group by lang, pos // 8)")
        return made

    out += tree("t", "select lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, leaf digest from lv")
    out += tree("u", f"select '' lang, row_number() over (order by lang nulls first) - 1 pos, digest from t{levels}")
    out.append(f"lr as (select lang l0, row_number() over (order by lang nulls first) - 1 pos, digest subroot from t{levels}), root as (select digest root from u{levels})")
    # Each row climbs level by level: its own digest, the folded one, and its siblings so far.
    out.append("w0 as (select doc_id, lang, leaf, new folded, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, '' proof from lv)")
    step = 0

    def climb(name: str, key: str) -> None:
        nonlocal step
        for k in range(levels):
            run = f"(select lang, pos // 8 pos, max(n) n, list(digest order by pos) kids from (select *, count(*) over (partition by lang) n from {name}{k}) group by lang, pos // 8)"
            others = "array_to_string(list_concat(kids[:(w.pos % 8)::int], kids[(w.pos % 8)::int + 2:]), '')"
            new = "sha256(array_to_string(list_concat(kids[:(w.pos % 8)::int], [folded], kids[(w.pos % 8)::int + 2:]), ''))"
            out.append(f"w{step + 1} as materialized (select w.* exclude (folded, pos, proof), case when n = 1 then folded else {new} end folded, w.pos // 8 pos, case when n = 1 then proof else proof || {others} end proof from w{step} w join {run} r on {key} and r.pos = w.pos // 8)")
            step += 1

    climb("t", "r.lang is not distinct from w.lang")
    out.append(f"w{step + 1} as materialized (select w.* exclude (pos), lr.pos, subroot from w{step} w join lr on l0 is not distinct from lang)")
    step += 1
    climb("u", "true")
    return ", ".join(out) + f" select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, folded folded_root, folded = root verified from w{step}, root"


#: 8^8 rows a language are more than the tables for checks have.
SQL = sql()
