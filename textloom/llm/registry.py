"""The queries of the operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_bpe, decontaminate, embeddings, importance, licenses, lm, merkle, pii, reshard, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": substrings.op1_substrings,
        "op2_simhash": simhash.op2_simhash,
        "op3_licenses": licenses.op3_licenses,
        "op4_pii": pii.op4_pii,
        "op5_embeddings": embeddings.op5_embeddings,
        "op6_bpe": bpe.op6_bpe,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_reshard": reshard.op8_reshard,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm": lm.op10_lm,
        "op11_merkle": merkle.op11_merkle,
        "op12_importance": importance.op12_importance,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": merkle.oracle_sql(), "op12_importance": importance.oracle_sql()}
