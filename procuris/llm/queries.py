"""The text operators' queries by name, and SQL where it can express them."""

from __future__ import annotations

from procuris.llm import audit, egojoin, langid, linededup, mixing, negatives, omh, packing, rotation, simhash, toxicity, warczip, wordbpe

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_line_dedup": linededup.op2,
    "op3_order_minhash": omh.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_toxicity": toxicity.op5,
    "op6_embedding_near_dedup": egojoin.op6,
    "op7_perspective_rotation": rotation.op7,
    "op8_source_mixing": mixing.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_warc_zip": warczip.op10,
    "op11_source_divergence": audit.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_word_bpe": wordbpe.op13,
}
SQL: dict[str, str] = {
    "op7_perspective_rotation": rotation.OP7_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op10_warc_zip": warczip.OP10_SQL,
    "op11_source_divergence": audit.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
