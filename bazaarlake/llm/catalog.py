"""The operators' queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaarlake.llm import fill_in_middle, source_audit, topk_search
from bazaarlake.llm.attention_lm import op6_lm_scoring
from bazaarlake.llm.decontaminate import op4_benchmark_decontamination
from bazaarlake.llm.html_text import op7_html_extraction
from bazaarlake.llm.language_id import op8_language_id
from bazaarlake.llm.packing import op9_packing
from bazaarlake.llm.quality_rules import op1_quality_rules
from bazaarlake.llm.simhash import op10_simhash_near_dedup
from bazaarlake.llm.suffix_dedup import op2_suffix_array_dedup
from bazaarlake.llm.token_counts import op3_token_counts
from bazaarlake.llm.url_filter import op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_topk_search": topk_search.op11_topk_search,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_source_divergence": source_audit.op13_source_divergence,
}
#: The others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op11_topk_search": topk_search.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_source_divergence": source_audit.SQL,
}
