"""Snapshots: all rows of a conversation in one JSON value, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT = "conv bigint, turns array<struct<turn: bigint, role: string, text: string>>"


def export_rows(turns: DataFrame) -> DataFrame:
    """conv_id, snapshot (JSON) of turns (conv_id, turn, role, text)."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns")).alias("snapshot"))


def import_rows(snapshots: DataFrame) -> DataFrame:
    parsed = snapshots.select(F.from_json("snapshot", SNAPSHOT).alias("s"))
    return parsed.select(F.col("s.conv").alias("conv_id"), F.inline("s.turns"))
