"""The subpackage's queries, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import decontaminate, language_model, line_dedup, near_dedup, packing, quality, secrets, substring_dedup, token_count, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_lm_scoring": language_model.op5_lm_scoring,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: The other operators are held against brute force in the tests.
ORACLES: dict[str, str] = {
    "op2_secret_scan": secrets.SQL,
    "op5_lm_scoring": language_model.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_url_filters": url_filter.SQL,
}
