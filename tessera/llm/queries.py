"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, language_id, line_dedup, merkle_manifest, mpeg_audio, ngram_join, packing, piece_encoding, quality_rules, token_trees, toxicity, trie_encoding, whitening
from .common import docs_table


def _over_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(docs_table(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": _over_documents(ngram_join.query),
        "op2_quality_rules": _over_documents(quality_rules.query),
        "op3_token_trees": _over_documents(token_trees.query),
        "op4_context_tree": _over_documents(context_tree.query),
        "op5_mpeg_audio": _over_documents(mpeg_audio.query),
        "op6_packing": _over_documents(packing.query),
        "op7_piece_encoding": _over_documents(piece_encoding.query),
        "op8_language_id": _over_documents(language_id.query),
        "op9_toxicity": toxicity.query,
        "op10_line_dedup": _over_documents(line_dedup.query),
        "op11_merkle_manifest": _over_documents(merkle_manifest.query),
        "op12_trie_encoding": _over_documents(trie_encoding.query),
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.SQL, "op10_line_dedup": line_dedup.SQL, "op11_merkle_manifest": merkle_manifest.SQL}
