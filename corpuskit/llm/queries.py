"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from corpuskit.llm import (
    bpe, edit_embedding, html_text, lexical, mixing, mtree, quality, sharding, simhash, suffix_dedup, toxicity, turn_repair,
    url_rules,
)

QUERIES = {
    "op1_shards": sharding.op1_shards,
    "op10_quality": quality.op10_quality,
    "op11_url_rules": url_rules.op11_url_rules,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_turn_repair": turn_repair.op13_turn_repair,
    "op2_main_text": html_text.op2_main_text,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_top_vectors": mtree.op4_top_vectors,
    "op5_repeated_strings": suffix_dedup.op5_repeated_strings,
    "op6_edit_fingerprints": edit_embedding.op6_edit_fingerprints,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_simhash_groups": simhash.op9_simhash_groups,
}

ORACLES = {
    "op11_url_rules": url_rules.OP11_SQL,
    "op12_ranked_search": lexical.OP12_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
    "op4_top_vectors": mtree.OP4_SQL,
    "op8_source_mix": mixing.OP8_SQL,
}
