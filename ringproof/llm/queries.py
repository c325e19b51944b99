"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from . import clusters, decontaminate, divergence, language_model, line_dedup, mixing, passages, pieces, pii, quality_classifier, quality_rules, simhash, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_pii": pii.op3_pii,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_passages": passages.op5_passages,
    "op6_warc": warc.op6_warc,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_language_model": language_model.op10_language_model,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_clusters": clusters.op12_clusters,
    "op13_mix": mixing.op13_mix,
}
SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op5_passages": passages.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_clusters": clusters.OP12_SQL,
    "op13_mix": mixing.OP13_SQL,
}
