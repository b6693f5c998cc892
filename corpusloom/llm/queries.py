"""Queries of this package and the SQL that gives the same rows, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op5_mixing, op10_topk
from .op1_quality import op1_quality_nbsvm
from .op2_minhash import op2_minhash_dedup
from .op3_secrets import op3_secret_scan
from .op4_sharding import op4_shard_placement
from .op6_tables import op6_token_tables
from .op7_urls import op7_url_filter
from .op8_html import op8_html_main_text
from .op9_decontaminate import op9_decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_nbsvm": op1_quality_nbsvm,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_shard_placement": op4_shard_placement,
    "op5_source_mixing": op5_mixing.op5_source_mixing,
    "op5_bounded_mixing": op5_mixing.op5_bounded_mixing,
    "op6_token_tables": op6_token_tables,
    "op7_url_filter": op7_url_filter,
    "op8_html_main_text": op8_html_main_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_topk": op10_topk.op10_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op5_source_mixing": op5_mixing.SQL,
    "op5_bounded_mixing": op5_mixing.BOUNDED_SQL,
    "op10_exact_topk": op10_topk.SQL,
}
