"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, htmltext, orderhash, pii, secrets, sharding, simhash, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.query,
    "op2_simhash": simhash.query,
    "op3_extendible_shards": sharding.query,
    "op4_decontamination": decontaminate.query,
    "op5_toxicity": toxicity.query,
    "op6_surrogates": pii.query,
    "op7_order_minhash": orderhash.query,
    "op8_url_filter": urls.query,
    "op9_main_text": htmltext.query,
    "op10_secrets": secrets.query,
}

SQL: dict[str, str] = {"op3_extendible_shards": sharding.SQL, "op8_url_filter": urls.SQL}
