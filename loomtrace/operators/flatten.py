"""Placing the contents of every cell at each of its instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.affine import AFFINE, apply_point, apply_track
from loomtrace.functions.layers import is_vertical
from loomtrace.functions.nets import UNKNOWN, is_placeholder
from loomtrace.functions.vias import via_layers
from loomtrace.operators.hierarchy import Instances
from loomtrace.sources.config import TechConfig
from loomtrace.sources.library import CELL, Layout, via_extensions


def _matrix() -> dict[str, F.Column]:
    return {name: F.col(name) for name in AFFINE}


def place_shapes(shapes: DataFrame, placed: DataFrame, on: list[str], orientation: dict[int, bool],
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Cell wires x placements -> wires (layer, p, s_start, s_end, net, *keep)."""
    joined = shapes.join(placed, on).withColumn("_vertical", is_vertical(F.col("layer"), orientation))
    track = apply_track(_matrix(), F.col("_vertical"), F.col("p"), F.col("s_start"), F.col("s_end"))
    return joined.select("layer", *[c.alias(n) for n, c in track.items()], "net", *keep)


def place_vias(vias: DataFrame, placed: DataFrame, on: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Cell vias x placements -> vias (vidx, type, lower, upper, x, y, *keep)."""
    return place_joined_vias(vias.join(placed, on), keep)


def place_joined_vias(joined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    x, y = apply_point(_matrix(), F.col("x"), F.col("y"))
    lower, upper = via_layers(F.col("type"))
    return joined.select("vidx", "type", lower.alias("lower"), upper.alias("upper"),
                         x.alias("x"), y.alias("y"), *keep)


def flat_wires(layout: Layout, placed: Instances, orientation: dict[int, bool]) -> DataFrame:
    """Every wire of every instance in top coordinates, with its global net name.

    Wires without a real name only need the placement; named ones meet the scope of their
    instance, which carries the placement too, so no wire is shuffled by instance.
    """
    anonymous = F.col("net").isNull() | is_placeholder(F.col("net"))
    plain = layout.wires.where(anonymous).withColumn(
        "net", F.when(F.col("net").isNotNull(), F.lit(UNKNOWN))
    )
    instances = placed.instances.select(F.col("idx").alias("inst_idx"), *CELL, *AFFINE)
    unnamed = place_shapes(plain.drop("kind"), instances, CELL, orientation, ("inst_idx",))
    scope = placed.scope.select(F.col("idx").alias("inst_idx"), *CELL, *AFFINE, "key", "net")
    named = layout.wires.where(~anonymous).drop("kind").withColumnRenamed("net", "key")
    resolved = place_shapes(named, scope, [*CELL, "key"], orientation, ("inst_idx",))
    return unnamed.unionByName(resolved)


def flat_vias(layout: Layout, instances: DataFrame, config: TechConfig) -> DataFrame:
    """Every via of every instance in top coordinates, numbered 1..n along the hierarchy."""
    rows = via_extensions(layout.vias, config)
    placed = instances.select(F.col("idx").alias("inst_idx"), *CELL, *AFFINE, "via_base")
    vidx = (F.col("via_base") + F.col("ord") + 1).alias("vidx")
    return place_joined_vias(rows.join(placed, CELL).withColumn("vidx", vidx), ("ext_x", "ext_y", "inst_idx"))
