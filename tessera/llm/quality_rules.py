"""Quality rules by weak supervision.

Each rule votes a document good, bad, or abstains. Expectation-maximisation over the
counts of vote patterns (at most 3 to the power of the rules, whatever the corpus) gives,
for each rule, how often it votes bad on bad and on good documents, and the share of bad
documents, with Beta priors; a document's posterior of being good replaces the demand
that it pass every rule. A rule has two rates, not one accuracy: most rules are silent on
most bad documents, but hardly ever wrong about good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, text_slices, written

#: Votes that the priors count for; prior rates of bad votes on bad and on good documents, and share of bad documents.
PRIOR_VOTES = 200.0
PRIOR_HIT, PRIOR_FALSE, PRIOR_BAD = 0.6, 0.05, 0.15
#: A document is kept from this posterior of being good on.
KEEP = 0.5
ROUNDS = 500

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
_BLANK = " \t\n\x0b\x0c\r"
_FEATURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_letters bigint, n_distinct bigint, n_symbol_words bigint, n_ended_lines bigint"
_ENDS = frozenset(".!?\"\u201d\u00bb\u2026\u3002\uff01\uff1f")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    for batch in batches:
        for i, j in text_slices(batch):
            rows = batch.slice(i, j - i)
            w = Words(rows.column(1), lower=False)
            sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
            inside = np.zeros(len(w.data) + 1, np.int8)
            np.add.at(inside, w.start, 1)
            np.add.at(inside, w.end, -1)
            inside = np.cumsum(inside[:-1]).astype(bool)
            lead = (w.data & 0xC0) != 0x80
            per = [np.diff(sums(m)[w.at]) for m in (lead & inside, _SYMBOL[w.data], _LETTER[w.data])]
            h, first = w.hash, w.first
            symbols = sums(_SYMBOL[w.data])
            marked = np.diff(sums(symbols[w.end] > symbols[w.start])[first])
            m = np.uint64(0xD6E8FEB86659FD93)
            tri = (h[:-2] * m + h[1:-1]) * m + h[2:] if len(h) > 2 else h[:0]
            repeat, distinct, dup, lines, ended = [], [], [], [], []
            for k, x in enumerate(rows.column(1)):
                a, b = first[k], first[k + 1]
                distinct.append(len(np.unique(h[a:b])))
                if b - a < 4:
                    repeat.append(0)
                else:
                    _, at, n = np.unique(tri[a : b - 2], return_inverse=True, return_counts=True)
                    hit = n[at] > 1
                    cover = np.zeros(b - a, bool)
                    for s in range(3):
                        cover[s : s + len(hit)] |= hit
                    repeat.append(int(cover.sum()))
                some = [y for y in (x.as_py() or "").split("\n") if y.strip(_BLANK)]
                lines.append(len(some))
                dup.append(len(some) - len(set(some)))
                ended.append(sum(y.rstrip(_BLANK)[-1] in _ENDS for y in some))
            long = lambda x: pa.array(np.asarray(x, np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), long(np.diff(first)), long(per[0]), long(per[1]), long(dup), long(repeat), long(lines), long(per[2]), long(distinct), long(marked), long(ended)], names)


def features(docs: DataFrame) -> DataFrame:
    """What the rules look at, for each row of ``docs``; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _FEATURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def _rules() -> dict[str, Column]:
    """Votes 1 (good), 0 (bad) or -1 (abstains)."""
    n, c = F.col("n_words"), F.col
    return {
        "length": _vote(n >= 80, n < 50),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 7 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 12 * n)),
        "symbols": _vote(c("n_symbols") * 50 <= n, c("n_symbols") * 8 > n),
        "symbol_words": _vote(c("n_symbol_words") * 50 <= n, c("n_symbol_words") * 8 > n),
        "duplicate_lines": _vote((c("n_lines") > 1) & (c("n_dup_lines") == 0), c("n_dup_lines") * 3 > c("n_lines")),
        "repetition": _vote(c("n_repeat_words") * 10 <= n, c("n_repeat_words") * 10 > n * 4),
        "letters": _vote(c("n_letters") * 100 >= c("word_chars") * 95, c("n_letters") * 10 < c("word_chars") * 9),
        "variety": _vote(c("n_distinct") * 2 >= n, c("n_distinct") * 20 < n),
        "sentences": _vote(c("n_ended_lines") == c("n_lines"), c("n_ended_lines") * 10 < c("n_lines") * 9),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(rate of bad votes of each rule on bad documents, on good ones, share of bad documents) from (votes, count) rows, by EM.

    A rule's rate on good documents is at most that on bad ones, so no rule is read backwards.
    """
    if not patterns:
        return np.zeros(0), np.zeros(0), PRIOR_BAD
    votes = np.array([p for p, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    hit, false, bad = np.full(votes.shape[1], PRIOR_HIT), np.full(votes.shape[1], PRIOR_FALSE), PRIOR_BAD
    against, any_ = votes == 0, votes >= 0
    for _ in range(ROUNDS):
        p = posterior(votes, hit, false, bad)
        good, ill = (p * count)[:, None], ((1 - p) * count)[:, None]
        rate = lambda w, prior: ((against * w).sum(0) + PRIOR_VOTES * prior) / ((any_ * w).sum(0) + PRIOR_VOTES)
        new_hit = np.clip(rate(ill, PRIOR_HIT), 1e-4, 1 - 1e-4)
        new_false = np.clip(np.minimum(rate(good, PRIOR_FALSE), new_hit), 1e-4, 1 - 1e-4)
        bad = float((ill.sum() + PRIOR_VOTES * PRIOR_BAD) / (count.sum() + PRIOR_VOTES))
        moved = max(np.abs(new_hit - hit).max(), np.abs(new_false - false).max())
        hit, false = new_hit, new_false
        if moved < 1e-9:
            break
    return hit, false, bad


def weights(hit: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a bad and a good vote of each rule add to the log odds of a good document."""
    return np.log(false / hit), np.log((1 - false) / (1 - hit))


def posterior(votes: np.ndarray, hit: np.ndarray, false: np.ndarray, bad: float) -> np.ndarray:
    """The probability that documents with these votes are good."""
    no, yes = weights(hit, false)
    odds = math.log((1 - bad) / bad) + (votes == 0) @ no + (votes == 1) @ yes
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def score(docs: DataFrame) -> DataFrame:
    """Features, ``base_failed``, ``quality`` (posterior) and ``kept`` of each row of ``docs``.

    Texts without words fail the base rules. Rows that repeat are scored alike, each.
    The votes are learned from all rows; no documents give no rows.
    """
    rules = _rules()
    names = [f"vote_{k}" for k in rules]
    base = written(features(docs).select("*", *(v.alias(f"vote_{k}") for k, v in rules.items())), "votes")
    seen = base.groupBy(names).count().collect()  # at most 3 ** len(rules) rows
    hit, false, bad = fit([(tuple(r[n] for n in names), r["count"]) for r in sorted(seen, key=lambda r: tuple(r[n] for n in names))])
    odds = F.lit(math.log((1 - bad) / bad))
    for n, no, yes in zip(names, *weights(hit, false), strict=False):  # no rules' rates without documents
        odds = odds + F.when(F.col(n) == 0, float(no)).when(F.col(n) == 1, float(yes)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = base.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def query(docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
