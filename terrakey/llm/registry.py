"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrakey.llm import merkle, quality, secrets, sort_means, vector_links
from terrakey.llm.decontamination import op6_decontamination
from terrakey.llm.html_text import op5_html_extraction
from terrakey.llm.language_id import op10_language_id
from terrakey.llm.licenses import op4_license_scans
from terrakey.llm.near_dedup import op7_near_dedup
from terrakey.llm.packing import op2_best_fit_packing
from terrakey.llm.sharding import op9_sharding
from terrakey.llm.token_counts import op3_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_license_scans": op4_license_scans,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_near_dedup": op7_near_dedup,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_nn_descent": vector_links.op12_nn_descent,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op8_secret_scans": secrets.ORACLE,
    "op11_sort_means": sort_means.ORACLE,
    "op12_nn_descent": vector_links.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
