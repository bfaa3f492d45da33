"""Geometry to draw: line segments of wires and outlines of vias. Drawing itself is left to
a plotting tool that reads these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.layers import is_vertical

def _color(column: str, colors: dict, other: str = "black") -> F.Column:
    value = F.lit(other)
    for key, color in colors.items():
        value = F.when(F.col(column) == key, F.lit(color)).otherwise(value)
    return value


def wire_segments(wires: DataFrame, orientation: dict[int, bool], colors: dict[int, str]) -> DataFrame:
    """(layer, x1, y1, x2, y2, color): each wire as a line; layers without a colour are black."""
    vertical = is_vertical(F.col("layer"), orientation)
    return wires.select(
        "layer",
        F.when(vertical, F.col("p")).otherwise(F.col("s_start")).alias("x1"),
        F.when(vertical, F.col("s_start")).otherwise(F.col("p")).alias("y1"),
        F.when(vertical, F.col("p")).otherwise(F.col("s_end")).alias("x2"),
        F.when(vertical, F.col("s_end")).otherwise(F.col("p")).alias("y2"),
        _color("layer", colors).alias("color"),
    )


def write_segments_by_layer(segments: DataFrame, path: str) -> None:
    """One folder of segments per layer."""
    segments.write.mode("overwrite").partitionBy("layer").json(path)


def via_outlines(vias: DataFrame, colors: dict[str, str], scale: float = 1.0) -> DataFrame:
    """(vidx, type, x1, y1, x2, y2, color): the rectangle of each via; types without a colour are black."""
    ex, ey = F.col("ext_x") * F.lit(scale), F.col("ext_y") * F.lit(scale)
    return vias.select(
        "vidx", "type",
        (F.col("x") - ex).alias("x1"), (F.col("y") - ey).alias("y1"),
        (F.col("x") + ex).alias("x2"), (F.col("y") + ey).alias("y2"),
        _color("type", colors).alias("color"),
    )
