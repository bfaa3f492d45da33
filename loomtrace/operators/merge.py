"""Union of overlapping and touching wires on each track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.nets import known
from loomtrace.operators.connect import locate
from loomtrace.operators.ordering import number_in_order
from loomtrace.workspace import Workspace

TRACK = ["p", "layer"]  # the more selective column first: sorts compare it first
TILE_BITS = 20  # a track is cut into tiles of 2**20 grid units


def _islands(df: DataFrame, group: list[str]) -> DataFrame:
    """Gaps and islands: rows of a group whose spans overlap or touch become one row."""
    in_order = Window.partitionBy(*group).orderBy("s_start", "s_end")
    reach = F.max("s_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("s_start") > F.col("_reach"), F.lit(True)).cast("int")
    return (
        df.withColumn("_reach", reach)
        .withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "_run")
        .agg(
            F.min("s_start").alias("s_start"),
            F.max("s_end").alias("s_end"),
            F.min("net").alias("net"),
            F.max("net_max").alias("net_max"),
        )
        .drop("_run")
    )


def merge_intervals(shapes: DataFrame, ws: Workspace, tile_bits: int = TILE_BITS) -> DataFrame:
    """(layer, p, s_start, s_end, net) -> merged wires with ``net`` and ``net_max``.

    ``net`` and ``net_max`` are the least and greatest known name on the wire; they differ
    exactly if the wire carries more than one name. ``merged_nets`` lists them all.

    A track may hold any share of the rows, so it is never one group: wires are cut at tile
    borders, wires that start on the same grid point collapse before the sort, and a tile is
    merged alone (at most 2**(tile_bits + 1) + 2 rows). Only islands that reach a tile border are
    then stitched along the whole track.
    """
    tile_of = lambda c: F.shiftright(c, tile_bits)
    left = F.shiftleft("tile", tile_bits)
    right = left + F.lit(1 << tile_bits)
    pieces = shapes.select(
        *TRACK, "s_start", "s_end", known(F.col("net")).alias("net"),
        F.explode(F.sequence(tile_of("s_start"), tile_of("s_end"))).alias("tile"),
    ).select(
        *TRACK, "tile",
        F.greatest("s_start", left).alias("s_start"),
        F.least("s_end", right).alias("s_end"),
        "net",
    )
    # Most wires have no name, and without strings to compare they collapse in a hash table.
    point = [*TRACK, "tile", "s_start"]
    longest = F.max("s_end").alias("s_end")
    no_name = F.lit(None).cast("string")
    unnamed = pieces.where(F.col("net").isNull()).groupBy(*point).agg(longest)
    named = pieces.where(F.col("net").isNotNull()).groupBy(*point).agg(
        longest, F.min("net").alias("net"), F.max("net").alias("net_max")
    )
    starts = unnamed.select("*", no_name.alias("net"), no_name.alias("net_max")).unionByName(named)
    islands = _islands(starts, [*TRACK, "tile"])
    at_border = (F.col("s_start") == left) | (F.col("s_end") == right)
    wire = ["layer", "p", "s_start", "s_end", "net", "net_max"]
    # Written once: both halves below read it, and so does the sampling of a later range sort.
    islands = ws.save(islands.select(*wire, at_border.alias("at_border")), "islands")
    inner = islands.where(~F.col("at_border")).select(*wire)
    stitched = _islands(islands.where("at_border").select(*wire), TRACK).select(*wire)
    return inner.unionByName(stitched)


def number_metals(merged: DataFrame, ws: Workspace) -> DataFrame:
    """Number merged wires 1..n in (layer, p, s_start) order."""
    numbered = number_in_order(merged, ["layer", "p", "s_start"], "idx", ws)
    return numbered.select("idx", "layer", "p", "s_start", "s_end", "net", "net_max")


def merged_nets(shapes: DataFrame, metals: DataFrame) -> DataFrame:
    """(idx, net): every name on every merged wire."""
    starts = shapes.select(*TRACK, F.col("s_start").alias("s"), known(F.col("net")).alias("net"))
    starts = starts.where(F.col("net").isNotNull()).distinct()
    return locate(starts, metals, closed=True).select("idx", "net").distinct()


def layer_counts(metals: DataFrame) -> DataFrame:
    """(layer, n_tracks, n_metals)."""
    tracks = metals.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("n"))
    return tracks.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.sum("n").alias("n_metals")
    )


def remove_wires(wires: DataFrame, gone: DataFrame) -> DataFrame:
    """Take one occurrence of each row of ``gone`` out of ``wires``."""
    return wires.exceptAll(gone)


def intra_metal_shorts(metals: DataFrame) -> DataFrame:
    """Merged wires on which more than one name is drawn."""
    return metals.where(F.col("net") != F.col("net_max"))


def unnamed_metals(metals: DataFrame) -> DataFrame:
    return metals.where(F.col("net").isNull() | (F.col("net") == "OBSTACLE"))
