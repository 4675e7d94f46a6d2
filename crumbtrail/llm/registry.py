"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crumbtrail.llm import decontaminate, dualtree, jaccard, langid, lines, manifest, mixing, outliers, pieces, quality, secret_scan, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": tokens.query,
    "op2_context_mixing": mixing.query,
    "op3_language_id": langid.query,
    "op4_line_dedup": lines.query,
    "op5_quality": quality.query,
    "op6_ngram_jaccard": jaccard.query,
    "op7_warc": warc.query,
    "op8_sentencepiece": pieces.query,
    "op9_quality_rules": outliers.query,
    "op10_decontamination": decontaminate.query,
    "op11_dual_tree": dualtree.query,
    "op12_merkle_manifest": manifest.query,
    "op13_secret_scan": secret_scan.query,
}
SQL: dict[str, str] = {"op4_line_dedup": lines.SQL, "op7_warc": warc.SQL, "op11_dual_tree": dualtree.SQL, "op12_merkle_manifest": manifest.SQL}
