"""The registered queries of this package and the SQL they must agree with."""

from __future__ import annotations

from spatialframes.llm import (
    chat,
    chunk_dedup,
    crf_toxicity,
    line_frequency,
    media,
    merkle,
    mixing,
    ngram_join,
    packing,
    pii,
    site_quality,
    vantage_clusters,
    winnow,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1,
    "op2_mixing": mixing.op2,
    "op3_line_frequency": line_frequency.op3,
    "op4_site_quality": site_quality.op4,
    "op5_line_dedup": winnow.op5,
    "op6_media_columns": media.op6,
    "op7_crf_toxicity": crf_toxicity.op7,
    "op8_packing": packing.op8,
    "op9_chat_format": chat.op9,
    "op10_personal_data": pii.op10,
    "op11_chunk_dedup": chunk_dedup.op11,
    "op12_vantage_clusters": vantage_clusters.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_line_frequency": line_frequency.OP3_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_chunk_dedup": chunk_dedup.OP11_SQL,
    "op12_vantage_clusters": vantage_clusters.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
