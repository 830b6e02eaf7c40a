"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from quillon.llm import class_lm, exact_dedup, fingerprints, language_id, minhash, mixing, packing, secrets, substring_dedup, token_files

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_near_dedup": minhash.op2_near_dedup,
    "op3_packing": packing.op3_packing,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_token_files": token_files.op5_token_files,
    "op6_class_lm": class_lm.op6_class_lm,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_near_dedup": minhash.OP2_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
