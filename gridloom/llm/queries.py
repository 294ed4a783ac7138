"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import alignment, byte_cnn, centroids, chosen_path, main_text, mixing, pair_bpe, quality_rules, simhash, token_counts, token_store, vector_join, warc


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_token_output": token_store.query,
        "op3_token_counts": token_counts.query,
        "op4_warc_derivatives": warc.query,
        "op5_main_text": main_text.query,
        "op6_pair_bpe": pair_bpe.query,
        "op7_jaccard_join": chosen_path.query,
        "op8_quality_classifier": byte_cnn.query,
        "op9_vector_join": vector_join.query,
        "op10_quality_rules": quality_rules.query,
        "op11_simhash": simhash.query,
        "op12_alignment": alignment.query,
        "op13_centroids": centroids.query,
    }


def oracle_sql() -> dict:
    """Only what SQL can express on whole tables; the rest is tested against brute force."""
    return {"op13_centroids": centroids.oracle_sql()}
