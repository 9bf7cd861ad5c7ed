"""Queries of the corpus operators and the SQL that gives the same rows."""

from . import codes, hnsw, langid, licenses, minhash, mixing, packing, quality, spelling, substring, tokens, topk, toxicity

QUERIES = {f.__name__: f for f in (langid.op1_language_mixture, substring.op2_fm_index_shards, tokens.op3_token_shards, toxicity.op4_sentence_bags, topk.op5_norm_buckets, hnsw.op6_graph_shards, mixing.op7_water_filled_mix, minhash.op8_chosen_paths, packing.op9_deficit_packing, quality.op10_compression_quality, spelling.op11_spelling_variants, codes.op12_elkan_codes, licenses.op13_license_notices)}
ORACLES = {"op5_norm_buckets": topk.OP5_SQL, "op7_water_filled_mix": mixing.OP7_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_elkan_codes": codes.OP12_SQL}
