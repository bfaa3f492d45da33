"""Which wires a via joins, and which vias lie on a wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.layers import is_vertical
from loomtrace.operators.ordering import number_in_order
from loomtrace.workspace import Workspace

# Wires are filed in bins along the track. A wire goes to the first scale whose bins are
# at least as long as the wire, so it covers two bins at most; wires beyond the last scale
# cover one bin per 2**18 grid units. Wires on a track are disjoint, so a bin of one scale
# holds at most 2**6 + 1 of them.
BIN_BITS = (6, 12, 18)

SITE = ["lower", "upper", "x", "y"]


def _scale_of(length: Column) -> Column:
    scale = F.lit(len(BIN_BITS) - 1)
    for n, bits in reversed(list(enumerate(BIN_BITS[:-1]))):
        scale = F.when(length <= (1 << bits), F.lit(n)).otherwise(scale)
    return scale


def _bin_of(s: Column, scale: Column) -> Column:
    out = F.shiftright(s, BIN_BITS[-1])
    for n, bits in reversed(list(enumerate(BIN_BITS[:-1]))):
        out = F.when(scale == n, F.shiftright(s, bits)).otherwise(out)
    return out


def locate(points: DataFrame, metals: DataFrame, closed: bool = False) -> DataFrame:
    """Join points (layer, p, s, ...) with the wire under them, adding ``idx``.

    The start of a wire is not on it (``s_start < s <= s_end``) unless ``closed``.
    """
    scale = F.col("_scale")
    binned = metals.select(
        "idx", "layer", "p", "s_start", "s_end",
        _scale_of(F.col("s_end") - F.col("s_start")).alias("_scale"),
    ).select("*", F.explode(F.sequence(_bin_of(F.col("s_start"), scale),
                                       _bin_of(F.col("s_end"), scale))).alias("_bin"))
    probes = points.select(
        "*", F.explode(F.array(*[F.lit(n) for n in range(len(BIN_BITS))])).alias("_scale")
    ).withColumn("_bin", _bin_of(F.col("s"), scale))
    after_start = F.col("s") >= F.col("s_start") if closed else F.col("s") > F.col("s_start")
    return (
        probes.join(binned, ["p", "_bin", "layer", "_scale"])  # the most selective first: sorts compare it first
        .where(after_start & (F.col("s") <= F.col("s_end")))
        .drop("_scale", "_bin", "s_start", "s_end")
    )


def endpoints(vias: DataFrame, orientation: dict[int, bool], once: bool = False) -> DataFrame:
    """Each via as one track point on either layer it joins.

    A via between a layer and itself gives two points, or one with ``once``.
    """
    vertical = is_vertical(F.col("layer"), orientation, strict=False)
    layers = F.array("lower", "upper")
    layers = F.array_distinct(layers) if once else layers
    return vias.withColumn("layer", F.explode(layers)).select(
        *[c for c in vias.columns if c not in ("x", "y")],
        "layer",
        F.when(vertical, F.col("x")).when(~vertical, F.col("y")).alias("p"),
        F.when(vertical, F.col("y")).when(~vertical, F.col("x")).alias("s"),
    )


def via_sites(vias: DataFrame) -> DataFrame:
    """Vias between the same layers at the same point join the same wires: one row each."""
    return vias.groupBy(*SITE).agg(F.min("vidx").alias("vidx"), F.count(F.lit(1)).alias("n_vias"))


def site_hits(sites: DataFrame, metals: DataFrame, orientation: dict[int, bool],
              closed: bool = False) -> DataFrame:
    """(vidx, hits, u, v) for every site that lies on a wire at all."""
    points = endpoints(sites.select("vidx", *SITE), orientation).select("vidx", "layer", "p", "s")
    return locate(points, metals, closed).groupBy("vidx").agg(
        F.count(F.lit(1)).alias("hits"), F.min("idx").alias("u"), F.max("idx").alias("v")
    )


def site_edges(vias: DataFrame, metals: DataFrame, orientation: dict[int, bool],
               closed: bool = False) -> DataFrame:
    """One edge (u, v) per via site that joins exactly two wires; enough for connectivity."""
    hits = site_hits(via_sites(vias), metals, orientation, closed)
    return hits.where(F.col("hits") == 2).select("u", "v")


def via_metal_lookup(vias: DataFrame, metals: DataFrame, orientation: dict[int, bool],
                     closed: bool = False) -> DataFrame:
    """(vidx, hits, u, v) for every via, parallel ones included; hits is 0 off the wires."""
    sites = via_sites(vias)
    hits = site_hits(sites, metals, orientation, closed)
    by_site = (
        sites.select(*SITE, "vidx").join(hits, "vidx", "left").drop("vidx")
        .withColumn("hits", F.coalesce("hits", F.lit(0)))
    )
    return vias.select("vidx", *SITE).join(by_site, SITE).select("vidx", "hits", "u", "v")


def connect_edges(vias: DataFrame, metals: DataFrame, orientation: dict[int, bool],
                  closed: bool = False) -> DataFrame:
    """(vidx, u, v) per via that joins exactly two wires."""
    found = via_metal_lookup(vias, metals, orientation, closed)
    return found.where(F.col("hits") == 2).select("vidx", "u", "v")


def dangling_vias(vias: DataFrame, metals: DataFrame, orientation: dict[int, bool],
                  closed: bool = False) -> DataFrame:
    """Vias that do not join two wires, with the number of wires they hit."""
    found = via_metal_lookup(vias, metals, orientation, closed)
    return found.where(F.col("hits") != 2).select("vidx", "hits")


def types_by_layer(vias: DataFrame) -> DataFrame:
    """(layer, type): the via types that touch each layer."""
    return vias.select(F.explode(F.array("lower", "upper")).alias("layer"), "type").distinct()


def vias_in_order(vias: DataFrame, ws: Workspace, first: str = "x") -> DataFrame:
    """Vias numbered by type, then from left to right and bottom to top; with ``first`` 'y' upwards first."""
    axes = ["x", "y"] if first == "x" else ["y", "x"]
    return number_in_order(vias.select("type", "x", "y", "vidx"), ["type", *axes, "vidx"], "place", ws)


def metal_via_lookup(metals: DataFrame, vias: DataFrame, orientation: dict[int, bool]) -> DataFrame:
    """(idx, vidx): the vias on each wire, both wire ends included."""
    sites = via_sites(vias).select("vidx", *SITE)
    points = endpoints(sites, orientation, once=True).select("vidx", "layer", "p", "s")
    on_site = sites.join(locate(points, metals, closed=True).select("vidx", "idx"), "vidx")
    return vias.select("vidx", *SITE).join(on_site.drop("vidx"), SITE).select("idx", "vidx")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, parallel edges kept."""
    return edges.select(F.col("u").alias("idx"), F.col("v").alias("neighbor")).unionByName(
        edges.select(F.col("v").alias("idx"), F.col("u").alias("neighbor"))
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("idx")).distinct()
