"""Question-answer example sources with an ordered fallback."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def qa_source_fallback(spark: SparkSession, paths: list[str], fallback: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """The first of ``paths`` that exists; else ``fallback``.

    Only a missing path goes on to the next source: a corrupt or unreadable one raises.
    """
    for p in paths:
        try:
            return spark.read.format(fmt).load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if fallback is None:
        raise FileNotFoundError(f"none of {paths} exists")
    return fallback
