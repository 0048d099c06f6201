"""The queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, fill_middle, grouped_prefix, language_pieces, mixing, prefix_trie, quality_rules, rare_features, retrieval_packing, sentence_spans, shard_tree, token_files, warc_zst


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (rare_features.op1_rare_features, sentence_spans.op2_sentence_spans, quality_rules.op3_quality_rules, warc_zst.op4_warc_zst, shard_tree.op5_shard_tree, grouped_prefix.op6_grouped_prefix, token_files.op7_token_files, language_pieces.op8_language_pieces, bpe_stream.op9_bpe_stream, mixing.op10_mixing, prefix_trie.op11_prefix_trie, retrieval_packing.op12_retrieval_packing, fill_middle.op13_skip_list_middle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sentence_spans": sentence_spans.OP2_SQL,
        "op3_quality_rules": quality_rules.OP3_SQL,
        "op4_warc_zst": warc_zst.OP4_SQL,
        "op6_grouped_prefix": grouped_prefix.OP6_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op13_skip_list_middle": fill_middle.OP13_SQL,
    }
