"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from linkmosaic.llm import licenses, mixing, packing, quality, sharding, simhash, suffixes, vectors, warc

QUERIES = {
    "op1_pivot_top_k": vectors.op1_pivot_top_k,
    "op2_line_crf_quality": quality.op2_line_crf_quality,
    "op3_cell_near_dedup": vectors.op3_cell_near_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_front_coded_suffixes": suffixes.op5_front_coded_suffixes,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_bin_completion_packing": packing.op7_bin_completion_packing,
    "op8_pivotal_mix": mixing.op8_pivotal_mix,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_feistel_sharding": sharding.op10_feistel_sharding,
}
ORACLES = {
    "op1_pivot_top_k": vectors.ORACLE_TOP_K,
    "op3_cell_near_dedup": vectors.ORACLE_NEAR,
    "op4_license_scan": licenses.ORACLE,
    "op6_warc_round_trip": warc.ORACLE,
}
