"""The queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, hardneg, langid, linefreq, merkle, mixing, neardup, packing, secrets, tokenbin, triecount, urltree, wacz


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_packing": packing.op1_packing,
        "op2_warc_packages": wacz.op2_warc_packages,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op5_token_files": tokenbin.op5_token_files,
        "op6_secrets": secrets.op6_secrets,
        "op7_token_counts": triecount.op7_token_counts,
        "op8_language": langid.op8_language,
        "op9_url_filter": urltree.op9_url_filter,
        "op10_quality_rules": linefreq.op10_quality_rules,
        "op11_mixing": mixing.op11_mixing,
        "op12_hard_negatives": hardneg.op12_hard_negatives,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
        "conversation_packing": packing.conversation_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_packages": wacz.ORACLE,
        "op3_decontamination": decontaminate.ORACLE,
        "op6_secrets": secrets.ORACLE,
        "op9_url_filter": urltree.ORACLE,
        "op10_quality_rules": linefreq.ORACLE,
        "op11_mixing": mixing.ORACLE,
        "op12_hard_negatives": hardneg.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
