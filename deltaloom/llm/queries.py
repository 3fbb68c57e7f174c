"""The queries of this subpackage and their SQL."""

from . import decontamination, language_id, line_rules, minhash, packing, quality, sharding, token_blocks, token_counts, toxicity

QUERIES = {
    "op1_quality": quality.query,
    "op2_language_id": language_id.query,
    "op3_sharding": sharding.query,
    "op4_minhash": minhash.query,
    "op5_decontamination": decontamination.query,
    "op6_token_blocks": token_blocks.query,
    "op7_toxicity": toxicity.query,
    "op8_token_counts": token_counts.query,
    "op9_packing": packing.query,
    "op10_line_rules": line_rules.query,
}
ORACLES: dict[str, str] = {"op3_sharding": sharding.ORACLE, "op4_minhash": minhash.ORACLE, "op10_line_rules": line_rules.ORACLE}
