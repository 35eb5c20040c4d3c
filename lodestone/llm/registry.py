"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fim, importance, jaccard_join, langid, licenses, media, mixing, packing, quality, secrets, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_shards": sharding.op2_shards,
        "op3_quality": quality.op3_quality,
        "op4_licenses": licenses.op4_licenses,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_packing": packing.op6_packing,
        "op7_language": langid.op7_language,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_media": media.op9_media,
        "op10_mix": mixing.op10_mix,
        "op11_fim": fim.op11_fim,
        "op12_importance": importance.op12_importance,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets.OP1_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op10_mix": mixing.OP10_SQL,
        "op11_fim": fim.OP11_SQL,
        "op12_importance": importance.OP12_SQL,
    }
