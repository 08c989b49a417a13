"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bagminhash, chat, jpeg, langid, linededup, mixing, packing, secrets, sphericalcaps, threshold, toxicity, turnrepair, warc



def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline lies at the repository's top, beside the package."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc_zip": warc.op1_warc_zip,
    "op2_chat_prefix_targets": chat.op2_chat_prefix_targets,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxic_neighbours": toxicity.op4_toxic_neighbours,
    "op5_language_families": langid.op5_language_families,
    "op6_spherical_caps": sphericalcaps.op6_spherical_caps,
    "op7_bagminhash": bagminhash.op7_bagminhash,
    "op8_secret_forest": secrets.op8_secret_forest,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_progressive_jpeg": jpeg.op10_progressive_jpeg,
    "op11_threshold_search": threshold.op11_threshold_search,
    "op12_line_dedup": linededup.op12_line_dedup,
    "op13_turn_repair": turnrepair.op13_turn_repair,
    "pipeline": _pipeline,
}
ORACLES = {
    "op1_warc_zip": warc.ORACLE,
    "op2_chat_prefix_targets": chat.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op11_threshold_search": threshold.ORACLE,
    "op12_line_dedup": linededup.ORACLE,
    "op13_turn_repair": turnrepair.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
