"""Kernels as SQL functions, and the seams where models and fetchers plug in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Make the kernels callable from SQL; returns their names."""
    from ..operators import alignment as al

    kernels = {"align_chars": al.align_chars, "similarity": al.similarity, "nfc": al.nfc, "best_window": al.best_window, "salvage_json": al.salvage_json_under, "find_glosses": al.find_glosses, "clean_text": al.clean_text, "diff_lines": al.diff_lines}
    for name, kernel in kernels.items():
        spark.udf.register(name, kernel)
    return sorted(kernels)
