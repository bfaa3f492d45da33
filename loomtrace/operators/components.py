"""Connected components of the wire graph, and the net-name check on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.workspace import Workspace


def _parents(links: DataFrame) -> DataFrame:
    return links.groupBy("hi").agg(F.min("lo").alias("parent"))


def _large_star(links: DataFrame) -> DataFrame:
    """Point every node at the least neighbor of its smaller neighbor."""
    parents = _parents(links).withColumnRenamed("hi", "lo")
    return links.join(parents, "lo", "left").select("hi", F.coalesce("parent", "lo").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node and all its smaller neighbors at the least of them."""
    moved = links.join(_parents(links), "hi").select(
        F.explode(F.array("hi", "lo")).alias("hi"), F.col("parent").alias("lo")
    )
    return moved.where(F.col("hi") != F.col("lo")).distinct()


def _is_star_forest(links: DataFrame) -> bool:
    """Whether the links are final.

    In a star forest every node points at one other node, and nobody points at a node that
    itself points on.
    """
    ends = links.select(
        F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("points")),
                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("points")))).alias("e")
    ).select("e.*")
    nodes = ends.groupBy("node").agg(
        F.sum("points").alias("out"), F.max(1 - F.col("points")).alias("target")
    )
    settled = F.col("out") + F.col("target") <= 1
    return nodes.where(~settled).isEmpty()


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(idx, comp_id) for every node of ``edges`` (u, v); comp_id is the least idx inside.

    Alternating large-star / small-star (Kiveris et al., SoCC 2014): the number of rounds
    grows with the logarithm of the graph, not with its longest path, and the link table
    never grows. The driver only sees one yes/no per round. Labels only fall, so the loop ends.
    """
    first = ws.save(
        edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(),
        "links",
    )
    links = first.where(F.col("hi") != F.col("lo"))
    before = None
    while not _is_star_forest(links):
        links = ws.save(_small_star(_large_star(links)), "links")
        if before is not None:
            ws.drop(before)
        before = links
    # A wire that a via joins only to itself is a node with no link.
    loops = first.where(F.col("hi") == F.col("lo"))
    centers = links.unionByName(loops).select("lo").distinct().select(
        F.col("lo").alias("idx"), F.col("lo").alias("comp_id")
    )
    if loops.isEmpty():
        return _members(links).unionByName(centers)
    # A self-joined wire may also hang on a star; its star wins.
    linked = _members(links)
    lonely = centers.join(linked, "idx", "left_anti")
    return linked.unionByName(lonely)


def _members(links: DataFrame) -> DataFrame:
    return links.select(F.col("hi").alias("idx"), F.col("lo").alias("comp_id"))


def component_members(labels: DataFrame, metals: DataFrame) -> DataFrame:
    """(comp_id, idx, net): the wires of every component."""
    return labels.join(metals.select("idx", "net"), "idx").select("comp_id", "idx", "net")


def component_report(members: DataFrame) -> DataFrame:
    """One row per component. It is consistent if its wires carry at most one name.

    Only the least and greatest name are kept, so a component of any size takes constant
    memory; ``component_nets`` lists all its names.
    """
    return members.groupBy("comp_id").agg(
        F.count(F.lit(1)).alias("n_metals"),
        F.min("net").alias("net"),
        F.coalesce(F.min("net") == F.max("net"), F.lit(True)).alias("is_consistent"),
    )


def component_nets(members: DataFrame) -> DataFrame:
    """(comp_id, net, first_idx): each name in a component and the first wire carrying it."""
    return members.where(F.col("net").isNotNull()).groupBy("comp_id", "net").agg(
        F.min("idx").alias("first_idx")
    )


def overall_consistency(report: DataFrame) -> DataFrame:
    """One row; an empty layout is consistent."""
    return report.agg(
        F.coalesce(F.bool_and("is_consistent"), F.lit(True)).alias("is_consistent"),
        F.count(F.lit(1)).alias("n_components"),
        F.coalesce(F.sum("n_metals"), F.lit(0)).alias("n_nodes"),
    )


def first_conflicts(members: DataFrame) -> DataFrame:
    """(comp_id, idx, net, expected): the first wire whose name is not the component's."""
    nets = component_nets(members)
    expected = nets.groupBy("comp_id").agg(F.min("net").alias("expected"))
    others = nets.join(expected, "comp_id")
    first = F.min(F.struct(F.col("first_idx").alias("idx"), "net")).alias("first")
    return (
        others.where(F.col("net") != F.col("expected"))
        .groupBy("comp_id", "expected").agg(first)
        .select("comp_id", "first.idx", "first.net", "expected")
    )


def all_labels(labels: DataFrame, metals: DataFrame) -> DataFrame:
    """Labels for all wires: one that no via joins to another is a group of its own."""
    return metals.join(labels, "idx", "left").select(
        F.coalesce("comp_id", "idx").alias("comp_id"), "idx", "net"
    )


def net_groups(labels: DataFrame, metals: DataFrame) -> DataFrame:
    """Every group of connected wires, single wires included, with its names counted."""
    members = all_labels(labels, metals)
    names = component_nets(members).groupBy("comp_id").agg(
        F.count(F.lit(1)).alias("n_nets"), F.min("net").alias("net")
    )
    sizes = members.groupBy("comp_id").agg(F.count(F.lit(1)).alias("n_metals"))
    return sizes.join(names, "comp_id", "left").select(
        "comp_id", "n_metals", F.coalesce("n_nets", F.lit(0)).alias("n_nets"), "net"
    )


def net_flood_fill(labels: DataFrame, metals: DataFrame) -> DataFrame:
    """(net, comp_id, n_metals): the groups a net floods, starting from its named wires.

    The wires flooded by a net are the members of its groups. Listing a group once per net
    and its members once (``all_labels``) keeps the result linear in the layout even where
    a group carries many names.
    """
    members = all_labels(labels, metals)
    sizes = members.groupBy("comp_id").agg(F.count(F.lit(1)).alias("n_metals"))
    return component_nets(members).join(sizes, "comp_id").select("net", "comp_id", "n_metals")
