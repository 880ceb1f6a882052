"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, hard_negatives, language_id, lexical_search, license_scan, mixing, near_dedup, quality, simhash, substring_dedup, topk_search, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_near_duplicates": near_dedup.op4_near_duplicates,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_simhash": simhash.op11_simhash,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": topk_search.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op10_decontamination": decontamination.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
