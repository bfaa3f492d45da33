"""Where a short is: a shortest way through the graph between two names of one component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.components import component_nets
from loomtrace.workspace import Workspace, row_count

CONFLICT = ["comp_id", "expected", "net"]


def conflicts(members: DataFrame) -> DataFrame:
    """(comp_id, expected, net): each name of a component that is not its least one."""
    nets = component_nets(members)
    expected = nets.groupBy("comp_id").agg(F.min("net").alias("expected"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return nets.join(expected, "comp_id").where("net <> expected").select(*CONFLICT)


def _adjacency(edges: DataFrame, wires: DataFrame) -> DataFrame:
    """(idx, neighbor, via): both directions of the edges between ``wires``, each with its least via."""
    pairs = edges.where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.min("vidx").alias("via"))
    pairs = pairs.join(wires.select(F.col("idx").alias("u")), "u", "left_semi")
    return pairs.select(F.col("u").alias("idx"), F.col("v").alias("neighbor"), "via").unionByName(
        pairs.select(F.col("v").alias("idx"), F.col("u").alias("neighbor"), "via"))


def short_paths(edges: DataFrame, members: DataFrame, ws: Workspace) -> DataFrame:
    """(comp_id, expected, net, step, idx, via): one shortest path per conflict, wire by wire.

    ``edges`` is (vidx, u, v), ``members`` (comp_id, idx, net). Step 0 is the wire with ``net``,
    the last step one with ``expected``; ``via`` leads to the next step's wire. Of several
    shortest paths the one whose wires come first by index is listed, then the least vias.

    All conflicts of a component share one breadth-first search from its expected name, so a
    wire is reached once, whatever the number of names; a component is left as soon as all its
    names are met. Each round joins the frontier with the edges and keeps, for each wire reached,
    the predecessor it came from. A round is compared with the two rounds before it only: what
    is next to a wire of one round lies in that round or in one beside it. The rounds are as
    many as the longest path has vias. A design without conflicts has no rows.
    """
    wanted = ws.save(conflicts(members), "conflicts")
    wires = ws.save(members.join(wanted.select("comp_id").distinct(), "comp_id", "left_semi"), "wires")
    near = ws.save(_adjacency(edges, wires), "near")
    sources = wires.join(wanted.select("comp_id", "expected").distinct(), "comp_id").where("net = expected")
    no_way = F.lit(None).cast("struct<idx:bigint,via:bigint>").alias("back")
    levels = [ws.save(sources.select("comp_id", "idx", no_way), "level")]
    ends, left = [], wanted
    while row_count(left):
        frontier = levels[-1].join(left.select("comp_id").distinct(), "comp_id", "left_semi")
        reached = frontier.join(near, "idx").groupBy("comp_id", F.col("neighbor").alias("_idx")).agg(
            F.min(F.struct("idx", "via")).alias("back")).withColumnRenamed("_idx", "idx")
        for before in levels[-2:]:
            reached = reached.join(before.select("idx"), "idx", "left_anti")
        levels.append(ws.save(reached.select("comp_id", "idx", "back"), "level"))
        if not row_count(levels[-1]):
            break
        named = wires.where(F.col("net").isNotNull()).select("idx", "net")
        met = levels[-1].select("comp_id", "idx").join(named, "idx").join(left, ["comp_id", "net"])
        ends.append(ws.save(met.groupBy(*CONFLICT).agg(F.min("idx").alias("idx")), "met"))
        if row_count(ends[-1]):
            left = ws.save(left.join(ends[-1], CONFLICT, "left_anti"), "left")
    return _walked_back(levels, ends, ws)


def _walked_back(levels: list[DataFrame], ends: list[DataFrame], ws: Workspace) -> DataFrame:
    """From each conflict's end, one step a level, along the predecessors."""
    out, here = [], None
    for distance in range(len(ends), -1, -1):
        if distance:
            start = ends[distance - 1].select(*CONFLICT, F.lit(0).alias("step"), "idx")
            here = start if here is None else here.unionByName(start)
        elif here is None:  # no conflict at all
            here = levels[0].limit(0).select("comp_id", *[F.lit("").alias(c) for c in CONFLICT[1:]],
                                             F.lit(0).alias("step"), "idx")
        step = ws.save(here.join(levels[distance].select("idx", "back"), "idx").select(
            *CONFLICT, "step", "idx", "back"), "step")
        out.append(step.select(*CONFLICT, "step", "idx", F.col("back.via").alias("via")))
        here = step.select(*CONFLICT, (F.col("step") + 1).alias("step"), F.col("back.idx").alias("idx"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found
