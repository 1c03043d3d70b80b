"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, knn, licences, line_dedup, mixing, pii, quality, simhash, token_files, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_quality": quality.op4_quality,
        "op5_pii": pii.op5_pii,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_licences": licences.op7_licences,
        "op8_knn": knn.op8_knn,
        "op9_token_files": token_files.op9_token_files,
        "op10_mixing": mixing.op10_mixing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_knn": knn.OP8_SQL, "op10_mixing": mixing.OP10_SQL}
