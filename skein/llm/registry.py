"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from skein.llm import decontaminate, filters, html, infill, mixing, neardup, privacy, quality, sharding, spans, suffixtree, toxicity, warc

QUERIES = {
    "op1_template_text": html.op1_template_text,
    "op2_entropy_mix": mixing.op2_entropy_mix,
    "op3_cgk_decontaminate": decontaminate.op3_cgk_decontaminate,
    "op4_information_sanitise": privacy.op4_information_sanitise,
    "op5_noisy_or_toxicity": toxicity.op5_noisy_or_toxicity,
    "op6_label_propagation": sharding.op6_label_propagation,
    "op7_sentence_spans": spans.op7_sentence_spans,
    "op8_merkle_audit": warc.op8_merkle_audit,
    "op9_signature_join": neardup.op9_signature_join,
    "op10_line_frequency": quality.op10_line_frequency,
    "op11_displacement_infill": infill.op11_displacement_infill,
    "op12_filter_interactions": filters.op12_filter_interactions,
    "op13_suffix_tree_scores": suffixtree.op13_suffix_tree_scores,
}

ORACLES = {
    "op8_merkle_audit": warc.OP8_SQL,
    "op10_line_frequency": quality.OP10_SQL,
    "op11_displacement_infill": infill.OP11_SQL,
    "op12_filter_interactions": filters.OP12_SQL,
}
