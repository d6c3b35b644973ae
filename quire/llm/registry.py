"""The corpus operators' queries and, where SQL can express them, their oracles."""

from . import alignment, bpe, embedding_dedup, exact_dedup, fingerprints, line_dedup, lm, mixing, near_dedup, periodicity, quality, secrets, sharding

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_secrets": secrets.op9_secrets,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_periodicity": periodicity.op11_periodicity,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op3_sharding": sharding.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_fingerprints": fingerprints.ORACLE_SQL,
}
