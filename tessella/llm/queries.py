"""The queries of the subpackage over the driver tables, with their oracle SQL."""

from __future__ import annotations

from tessella.llm import bytedups, chat, clustering, decontamination, katz, maintext, packing, passages, quality, simhash, tokencounts, vectorcodes, warc
from tessella.llm.common import table
from tessella.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_simhash": lambda spark, d: simhash.report(table(spark, d, "documents")),
    "op2_katz_scores": lambda spark, d: katz.scored(table(spark, d, "documents")),
    "op3_warc": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op4_byte_dedup": lambda spark, d: bytedups.report(table(spark, d, "documents")),
    "op5_best_fit_packing": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "op6_token_counts": lambda spark, d: tokencounts.section_counts(table(spark, d, "documents")),
    "op7_decontamination": lambda spark, d: decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_quality_rules": lambda spark, d: quality.quality(table(spark, d, "documents")),
    "op9_compact_windows": lambda spark, d: passages.report(table(spark, d, "documents")),
    "op10_chat_format": lambda spark, d: chat.report(table(spark, d, "conversations")),
    "op11_dual_tree_clusters": lambda spark, d: clustering.clusters(table(spark, d, "embeddings")),
    "op12_vector_codes": lambda spark, d: vectorcodes.compressed(table(spark, d, "embeddings")),
    "op13_main_text": lambda spark, d: maintext.extracted(table(spark, d, "pages")),
}
