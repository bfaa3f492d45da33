"""The connectivity check from summaries of cells, without flattening the design.

Most of what a cell holds meets nothing outside it, so it looks the same in every instance.
It is worked out once per cell and way of mirroring it (a via on a wire's end joins it at one
end only): merged wires, which vias join two of them, local components.
Only content that may meet another instance's is placed. The content of a cell is covered by
few boxes; where placed boxes of two instances touch, their wires are exported to the top,
together with the vias that do not join two wires of their own cell. Exported wires merge with
each other there, such vias find their wires there, and what they join connects local
components. Shuffled rows grow with the distinct cells, with the instances' boxes and with what
really overlaps, not with the flattened design.

Why this is exact: wires merge only where they touch, so only inside touching boxes. A via that
joins two wires of its own cell joins what these merge into. Any other via can only gain a
wire that reaches its point, which lies in a box then touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.affine import AFFINE, apply_point, apply_track
from loomtrace.functions.layers import is_vertical
from loomtrace.functions.nets import is_placeholder, known
from loomtrace.functions.vias import via_layers
from loomtrace.operators.components import connected_components
from loomtrace.operators.connect import SITE, endpoints, locate, via_sites
from loomtrace.operators.hierarchy import Instances
from loomtrace.operators.merge import merge_intervals, merged_nets
from loomtrace.sources.library import CELL, Layout
from loomtrace.workspace import Workspace

BOXES = 8  # a cell's content is cut into at most about this many boxes along each side
# Boxes meet in tiles of the first of these sizes (powers of two) that is not smaller than the larger one.
TILE_BITS = (8, 12, 16, 20, 24, 40)
BOX = ["cid", "bx", "by"]
TURN = ["a", "b", "c", "d"]
TURNED = [*CELL, *TURN]


@dataclass(frozen=True)
class Summaries:
    """What is known of each placed cell alone; saved tables.

    cells: lib, cell, a..d, cid          mirrored ones are cells of their own, drawn as they are placed
    wires: cid, wire, layer, p, s_start, s_end, comp (null without a via to another wire)
    names: cid, wire, key      the names drawn on it
    open_vias: cid, via, lower, upper, x, y      those that do not join two wires of the cell
    """

    cells: DataFrame
    wires: DataFrame
    names: DataFrame
    open_vias: DataFrame


def summarize(layout: Layout, instances: DataFrame, orientation: dict[int, bool], ws: Workspace) -> Summaries:
    """Merge, connect and label the contents of each distinct cell once."""
    cells = ws.save(instances.select(*TURNED).distinct().withColumn("cid", F.monotonically_increasing_id()), "cells")
    turn = {n: F.col(n) for n in TURN} | {n: F.lit(0).cast("bigint") for n in ("tx", "ty")}
    # Tracks of different cells are different layers to the operators that know tracks only.
    own_layer = F.struct("cid", "layer")
    track = apply_track(turn, is_vertical(F.col("layer"), orientation), F.col("p"), F.col("s_start"), F.col("s_end"))
    shapes = layout.wires.join(cells, CELL).select(
        own_layer.alias("layer"), *[c.alias(n) for n, c in track.items()],
        F.when(~is_placeholder(F.col("net")), F.col("net")).alias("net"))
    merged = ws.save(
        merge_intervals(shapes, ws).withColumn("idx", F.monotonically_increasing_id()).drop("net", "net_max"), "local")
    names = ws.save(merged_nets(shapes, merged).join(merged, "idx").select(
        F.col("layer.cid").alias("cid"), F.col("idx").alias("wire"), F.col("net").alias("key")), "local-names")
    lower, upper = via_layers(F.col("type"))
    x, y = apply_point(turn, F.col("x"), F.col("y"))
    vias = layout.vias.join(cells, CELL).select(
        "cid", lower.alias("lower"), upper.alias("upper"), x.alias("x"), y.alias("y")).distinct()
    vias = ws.save(vias.withColumn("via", F.monotonically_increasing_id()), "local-vias")
    points = endpoints(vias, orientation).select("via", own_layer.alias("layer"), "p", "s")
    hits = ws.save(locate(points, merged).groupBy("via").agg(
        F.count(F.lit(1)).alias("hits"), F.min("idx").alias("u"), F.max("idx").alias("v")).where("hits = 2"), "local-hits")
    labels = connected_components(hits.select("u", "v"), ws)
    wires = merged.join(labels, "idx", "left").select(
        F.col("layer.cid").alias("cid"), F.col("idx").alias("wire"), F.col("layer.layer").alias("layer"),
        "p", "s_start", "s_end", F.col("comp_id").alias("comp"))
    return Summaries(cells, ws.save(wires, "local-wires"), names,
                     ws.save(vias.join(hits, "via", "left_anti"), "open-vias"))


def content_boxes(parts: Summaries, orientation: dict[int, bool], ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(cid, bx, by, x0, y0, x1, y1), the boxes that cover each cell's content, and
    (cid, bx, by, kind, id), the wires and open vias in each; a box is a tile drawn tight."""
    vertical = is_vertical(F.col("layer"), orientation)
    across, along = [F.col("p"), F.col("p")], [F.col("s_start"), F.col("s_end")]
    x0, x1 = (F.when(vertical, a).otherwise(b) for a, b in zip(across, along, strict=True))
    y0, y1 = (F.when(vertical, b).otherwise(a) for a, b in zip(across, along, strict=True))
    rects = parts.wires.select("cid", F.lit("wire").alias("kind"), F.col("wire").alias("id"), x0.alias("x0"),
                               y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).unionByName(
        parts.open_vias.select("cid", F.lit("via").alias("kind"), F.col("via").alias("id"), F.col("x").alias("x0"),
                               F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")))
    side = F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))
    bits = rects.groupBy("cid").agg(F.ceil(F.log2(side / BOXES + 1)).cast("int").alias("bits"))

    def tile(c: str) -> Column:
        return F.expr(f"shiftright({c}, bits)")

    cut = rects.join(bits, "cid").select(
        "*", F.explode(F.sequence(tile("x0"), tile("x1"))).alias("bx")).select(
        "*", F.explode(F.sequence(tile("y0"), tile("y1"))).alias("by"))
    left, low, size = F.expr("shiftleft(bx, bits)"), F.expr("shiftleft(by, bits)"), F.expr("shiftleft(1L, bits)")
    pieces = ws.save(cut.select(
        *BOX, "kind", "id", F.greatest("x0", left).alias("x0"), F.greatest("y0", low).alias("y0"),
        F.least("x1", left + size).alias("x1"), F.least("y1", low + size).alias("y1")), "pieces")
    boxes = pieces.groupBy(*BOX).agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")])
    return boxes, pieces.select(*BOX, "kind", "id")


def touching_boxes(placed: DataFrame, ws: Workspace) -> DataFrame:
    """(inst, cid, bx, by): boxes of ``placed`` (and x0..y1) that touch a box of another instance.

    A box lives in the tiles of its own size class, four at most, and visits those of every
    larger class, again four at most; two boxes meet where the larger one lives.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    own = F.lit(len(TILE_BITS) - 1)
    for n, bits in reversed(list(enumerate(TILE_BITS[:-1]))):
        own = F.when(side <= (1 << bits), F.lit(n)).otherwise(own)
    boxes = ws.save(placed.withColumn("own", own), "boxes")
    bits = F.element_at(F.array(*[F.lit(b) for b in TILE_BITS]), F.col("class") + 1)

    def tiles(classes: Column, name: str) -> DataFrame:
        rows = boxes.select("*", F.explode(classes).alias("class")).withColumn("bits", bits)
        rows = rows.select("*", F.explode(F.expr("sequence(shiftright(x0, bits), shiftright(x1, bits))")).alias("gx"))
        rows = rows.select("*", F.explode(F.expr("sequence(shiftright(y0, bits), shiftright(y1, bits))")).alias("gy"))
        return rows.select("class", "gx", "gy", F.struct("inst", *BOX, "x0", "y0", "x1", "y1").alias(name))

    homes = tiles(F.array("own"), "a")
    visits = tiles(F.sequence("own", F.lit(len(TILE_BITS) - 1)), "b")
    touch = (F.col("a.inst") != F.col("b.inst"))
    for axis in "xy":
        touch = touch & (F.col(f"a.{axis}0") <= F.col(f"b.{axis}1")) & (F.col(f"b.{axis}0") <= F.col(f"a.{axis}1"))
    pairs = homes.join(visits, ["class", "gx", "gy"]).where(touch)
    return pairs.select(F.explode(F.array("a", "b")).alias("box")).select("box.inst", *[f"box.{c}" for c in BOX]).distinct()


def _first(layer: Column, p: Column, s: Column) -> Column:
    """What orders wires; the least of a component names it."""
    return F.struct(layer.alias("layer"), p.alias("p"), s.alias("s_start"))


def _shift(vertical: Column) -> tuple[Column, Column]:
    """How far a placement moves a wire across and along its track."""
    return F.when(vertical, F.col("tx")).otherwise(F.col("ty")), F.when(vertical, F.col("ty")).otherwise(F.col("tx"))


def hierarchical_report(layout: Layout, placed: Instances, orientation: dict[int, bool], ws: Workspace) -> DataFrame:
    """One row per component of the whole design: its first wire (layer, p, s_start), n_metals, net, is_consistent.

    The rows are those of ``component_report`` over the flattened design, named by their first
    wire rather than by its number. Quarter-turn placements raise, as they do there.
    """
    inst = placed.instances.select(F.col("idx").alias("inst"), *CELL, *AFFINE)
    parts = summarize(layout, inst, orientation, ws)
    inst = ws.save(inst.join(parts.cells, TURNED).select("inst", "cid", "tx", "ty"), "placed")
    scope = ws.save(placed.scope.select(F.col("idx").alias("inst"), "key", known(F.col("net")).alias("net")), "scopes")
    exported = _export(parts, inst, orientation, ws)
    wires = ws.save(exported.where("kind = 'wire'").select("inst", "cid", F.col("id").alias("wire"), "tx", "ty").join(
        parts.wires.drop("cid"), "wire"), "exported")
    supers, glued = _glue(parts, exported, wires, scope, orientation, ws)
    return _report(parts, inst, scope, wires, supers, glued, orientation, ws)


def _export(parts: Summaries, inst: DataFrame, orientation: dict[int, bool], ws: Workspace) -> DataFrame:
    """(inst, cid, kind, id, tx, ty): the wires and open vias in boxes that another instance's boxes touch."""
    boxes, pieces = content_boxes(parts, orientation, ws)
    moved = inst.join(boxes, "cid").select(
        "inst", *BOX, *[(F.col(f"{c}{n}") + F.col(f"t{c}")).alias(f"{c}{n}") for n in (0, 1) for c in "xy"])
    found = touching_boxes(moved, ws).join(pieces, BOX).select("inst", "kind", "id").distinct()
    return ws.save(found.join(inst, "inst"), "exports")


def _resolved(names: DataFrame, scope: DataFrame, by: list[str]) -> DataFrame:
    """(*by, net): the least name that ``names`` (inst, key, *by) have in their instances."""
    return names.join(scope, ["inst", "key"]).where(F.col("net").isNotNull()).groupBy(*by).agg(F.min("net").alias("net"))


def _glue(parts: Summaries, exported: DataFrame, wires: DataFrame, scope: DataFrame, orientation: dict[int, bool],
          ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(idx, layer, p, s_start, s_end, net, label): exported wires as merged at the top, and
    (inst, comp, label): the components that the local components with exported wires belong to."""
    drawn = wires.select("inst", "wire").join(parts.names.drop("cid"), "wire")
    named = drawn.join(scope, ["inst", "key"]).select("inst", "wire", "net")
    across, along = _shift(is_vertical(F.col("layer"), orientation))
    top = ws.save(wires.select("inst", "wire", "comp", "layer", (F.col("p") + across).alias("p"),
                               *[(F.col(c) + along).alias(c) for c in ("s_start", "s_end")]), "top")
    shapes = top.join(named, ["inst", "wire"], "left")
    supers = ws.save(merge_intervals(shapes, ws).drop("net_max").withColumn("idx", 2 * F.monotonically_increasing_id()),
                     "supers")
    comps = ws.save(top.where(F.col("comp").isNotNull()).select("inst", "comp").distinct()
                    .withColumn("node", 2 * F.monotonically_increasing_id() + 1), "glued")
    starts = top.where(F.col("comp").isNotNull()).select("layer", "p", F.col("s_start").alias("s"), "inst", "comp")
    joins = locate(starts, supers, closed=True).join(comps, ["inst", "comp"]).select(
        F.col("idx").alias("u"), F.col("node").alias("v"))
    x, y = F.col("x") + F.col("tx"), F.col("y") + F.col("ty")
    vias = exported.where("kind = 'via'").withColumnRenamed("id", "via").join(parts.open_vias.drop("cid"), "via").select(
        F.monotonically_increasing_id().alias("vidx"), "lower", "upper", x.alias("x"), y.alias("y"))
    sites = ws.save(via_sites(vias), "open-sites")
    points = endpoints(sites.select("vidx", *SITE), orientation).select("vidx", "layer", "p", "s")
    hits = locate(points, supers).groupBy("vidx").agg(
        F.count(F.lit(1)).alias("hits"), F.min("idx").alias("u"), F.max("idx").alias("v")).where("hits = 2")
    labels = ws.save(connected_components(joins.unionByName(hits.select("u", "v")), ws), "labels")
    label = F.col("comp_id").alias("label")
    return (supers.join(labels, "idx").select("idx", "layer", "p", "s_start", "s_end", "net", label),
            comps.join(labels.withColumnRenamed("idx", "node"), "node").select("inst", "comp", label))


def _report(parts: Summaries, inst: DataFrame, scope: DataFrame, wires: DataFrame, supers: DataFrame,
            glued: DataFrame, orientation: dict[int, bool], ws: Workspace) -> DataFrame:
    glued = ws.save(glued, "glued-comps")
    local = parts.wires.where(F.col("comp").isNotNull())
    first = F.min(_first(F.col("layer"), F.col("p"), F.col("s_start"))).alias("first")
    sums = ws.save(local.groupBy("cid", "comp").agg(F.count(F.lit(1)).alias("n"), first), "local-comps")
    # Names per wire first: a component's wires are compared by the least name of each. Inside a cell
    # wires with the same names are one.
    keys = local.select("comp", "wire").join(parts.names, "wire").groupBy("cid", "comp", "wire").agg(
        F.array_sort(F.collect_set("key")).alias("keys"))
    keys = ws.save(keys, "local-keys")
    across, along = _shift(is_vertical(F.col("first.layer"), orientation))
    first = _first(F.col("first.layer"), F.col("first.p") + across, F.col("first.s_start") + along).alias("first")
    everywhere = inst.join(sums, "cid").select("inst", "comp", "n", first)

    # Local components that meet nothing: their summary stands, placed.
    alone = everywhere.join(glued, ["inst", "comp"], "left_anti")
    asked = inst.select("inst", "cid").join(keys.select("cid", "comp", "keys").distinct(), "cid").join(
        glued.select("inst", "comp"), ["inst", "comp"], "left_anti")
    nets = _resolved(asked.select("inst", "comp", "keys", F.explode("keys").alias("key")), scope, ["inst", "comp", "keys"])
    ends = [F.min("net").alias("net"), F.max("net").alias("net_max")]
    done = alone.join(nets.groupBy("inst", "comp").agg(*ends), ["inst", "comp"], "left").select(
        "first", F.col("n").alias("n_metals"), "net", "net_max")

    # The others count only their wires that were not exported; those count as merged at the top.
    out = wires.where(F.col("comp").isNotNull()).groupBy("inst", "comp").agg(F.count(F.lit(1)).alias("gone"))
    inner = everywhere.join(glued, ["inst", "comp"]).join(out, ["inst", "comp"]).select(
        "label", "first", (F.col("n") - F.col("gone")).alias("n"))
    kept = glued.join(inst.select("inst", "cid"), "inst").join(keys, ["cid", "comp"]).join(
        wires.select("inst", "wire"), ["inst", "wire"], "left_anti")
    inner_nets = _resolved(kept.select("inst", "wire", "label", F.explode("keys").alias("key")), scope,
                           ["inst", "wire", "label"])
    no_net, no_first = F.lit(None).cast("string").alias("net"), F.lit(None).cast("struct<layer:int,p:bigint,s_start:bigint>")
    rows = inner.select("label", "first", "n", no_net).unionByName(
        supers.select("label", _first(F.col("layer"), F.col("p"), F.col("s_start")).alias("first"),
                      F.lit(1).cast("bigint").alias("n"), "net")).unionByName(
        inner_nets.select("label", no_first.alias("first"), F.lit(0).cast("bigint").alias("n"), "net"))
    joined = rows.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("n_metals"), *ends)
    return done.unionByName(joined.select("first", "n_metals", "net", "net_max")).select(
        "first.*", "n_metals", "net", F.coalesce(F.col("net") == F.col("net_max"), F.lit(True)).alias("is_consistent"))
