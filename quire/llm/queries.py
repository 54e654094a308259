"""The queries of this subpackage over the whole tables, and their DuckDB SQL where SQL can express them."""

from quire.llm import audit, bpe, fim, links, lm, matroska, minhash, mixing, partenum, quality, quotes, repair, suffixes

QUERIES = {
    "op1_matroska_media": matroska.op1,
    "op2_link_trust": links.op2,
    "op3_suffix_dedup": suffixes.op3,
    "op4_quote_threads": quotes.op4,
    "op5_partenum_join": partenum.op5,
    "op6_bpe": bpe.op6,
    "op7_repair_ids": repair.op7,
    "op8_systematic_mix": mixing.op8,
    "op9_quality_rules": quality.op9,
    "op10_cross_entropy": lm.op10,
    "op11_source_divergence": audit.op11,
    "op12_minhash_near": minhash.op12,
    "op13_fill_in_middle": fim.op13,
}

ORACLE_SQL = {
    "op5_partenum_join": minhash.jaccard_sql(partenum.SHINGLE, partenum.SIMILAR),
    "op8_systematic_mix": mixing.SQL,
    "op9_quality_rules": quality.SQL,
    "op11_source_divergence": audit.SQL,
    "op12_minhash_near": minhash.SQL,
    "op13_fill_in_middle": fim.SQL,
}
