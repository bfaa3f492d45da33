"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.affine import AFFINE, ORIENTATIONS, apply_rect, placement
from loomtrace.functions.layers import is_vertical, layer_number, layer_title, track_columns
from loomtrace.functions.nets import alias_map, unify
from loomtrace.functions.vias import via_layers
from loomtrace.operators import components as comp
from loomtrace.operators import connect, hierarchy, merge, opens, summary, sweep, trace
from loomtrace.operators.flatten import flat_vias, flat_wires
from loomtrace.sinks import drawing, report, via_json
from loomtrace.sources import driver_tables as dt
from loomtrace.sources import library
from loomtrace.sources.library import CELL, via_extensions
from loomtrace.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- scalar functions

@query
def layer_parse(spark, sf):
    n = (1 + F.col("l_linenumber") % 5).cast("string")
    style = F.col("l_orderkey") % 3
    name = (F.when(style == 0, F.concat(F.lit("M"), n)).when(style == 1, F.concat(F.lit("Metal"), n))
            .otherwise(F.concat(F.lit(" METAL"), n)))
    names = dt.table(spark, sf, "lineitem").select(name.alias("layer_name")).groupBy("layer_name").agg(
        F.count(F.lit(1)).alias("n_wires"))
    number = layer_number(F.col("layer_name"))
    return names.select("layer_name", number.alias("layer"), layer_title(number).alias("title"), "n_wires")


@query
def max_layer(spark, sf):
    names = layer_parse(spark, sf)
    return names.agg(F.max("layer").alias("max_layer"))


@query
def orientation_project(spark, sf):
    x0, y0 = (F.col("l_partkey") % 40) * 10, (F.col("l_orderkey") % 40) * 10
    length = F.col("l_quantity").cast("bigint")
    rects = dt.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (1 + F.col("l_linenumber") % 5).cast("int").alias("layer"),
        x0.alias("x0"), y0.alias("y0"), (x0 + length).alias("x1"), (y0 - length).alias("y1"),
        (F.col("l_suppkey") % 7).alias("hext"), (F.col("l_suppkey") % 5).alias("vext"),
    ).withColumn("vertical", is_vertical(F.col("layer"), dt.ORIENTATION))
    track = track_columns(*[F.col(c) for c in ("vertical", "x0", "y0", "x1", "y1", "hext", "vext")])
    return rects.select("l_orderkey", "l_linenumber", "layer", "vertical",
                        *[c.alias(n) for n, c in track.items()])


@query
def net_unify(spark, sf):
    aliases = alias_map([["ROAD", "AUTOMOBILE", "MACHINERY"], ["HOME", "BUILDING", "HOUSEHOLD"]])
    nets = dt.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("net"))
    return unify(nets, "net", aliases)


@query
def via_type_layers(spark, sf):
    types = dt.cell_vias(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n_vias"))
    lower, upper = via_layers(F.col("type"))
    return types.select("type", lower.alias("lower"), upper.alias("upper"), "n_vias")


@query
def search_via_types(spark, sf):
    return connect.types_by_layer(dt.placed_vias(spark, sf))


@query
def affine_rects(spark, sf):
    names = F.array(*[F.lit(n) for n in ORIENTATIONS])
    rects = dt.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")).alias("transform"),
        (F.col("l_partkey") % 40).alias("x0"), (F.col("l_orderkey") % 40).alias("y0"),
        F.col("l_suppkey").alias("tx"), (F.col("l_suppkey") * 2).alias("ty"),
    ).withColumn("x1", F.col("x0") + 7).withColumn("y1", F.col("y0") + 3)
    m = placement(F.col("transform"), F.col("tx"), F.col("ty"))
    rects = rects.select("l_orderkey", "l_linenumber", "transform", "x0", "y0", "x1", "y1",
                         *[c.alias(n) for n, c in m.items()])
    moved = apply_rect({n: F.col(n) for n in AFFINE}, *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return rects.select("l_orderkey", "l_linenumber", "transform", *[c.alias(n) for n, c in moved.items()])


@query
def affine_metals(spark, sf):
    return dt.placed_shapes(spark, sf)


@query
def affine_vias(spark, sf):
    return dt.placed_vias(spark, sf).select("vidx", "lower", "upper", "x", "y")


# ---------------------------------------------------------------- hierarchy and flatten

def _cells(spark, sf):
    """The layout, its reachable cells, and where tables go."""
    ws = Workspace(spark)
    layout = dt.hierarchy(spark, sf)
    links = ws.save(layout.subblocks.select(*CELL, *hierarchy.SUB).distinct(), "links")
    reach = hierarchy.reachable_cells(spark, dt.LIB, dt.CHIP, lambda libs: links, ws, False)
    hierarchy.check_cells(reach, layout.cells)
    return layout, reach, ws


def _placed(spark, sf):
    layout, reach, ws = _cells(spark, sf)
    return layout, hierarchy.expand_instances(layout, reach, dt.LIB, dt.CHIP, ws).instances


def _design(spark, sf, strict_null=False):
    layout, reach, ws = _cells(spark, sf)
    return layout, hierarchy.build_instances(layout, reach, dt.LIB, dt.CHIP, ws, strict_null), ws


@query
def hierarchy_expand(spark, sf):
    _, instances = _placed(spark, sf)
    return instances.select("idx", "parent_idx", "depth", "cell", "inst_name", "m_name",
                                   *AFFINE, "width", "height")


@query
def usable_blocks(spark, sf):
    """Device templates become instances in the top cell only, here the cell of nation 0."""
    return hierarchy.usable_blocks(dt.template_blocks(spark, sf), dt.LIB, "N0")


@query
def net_propagation(spark, sf):
    _, placed, _ = _design(spark, sf)
    return placed.scope.select("idx", "cell", "key", "net")


@query
def flatten_metals(spark, sf):
    layout, placed, _ = _design(spark, sf)
    return flat_wires(layout, placed, dt.ORIENTATION)


@query
def flatten_vias(spark, sf):
    layout, instances = _placed(spark, sf)
    return flat_vias(layout, instances, dt.CONFIG).select("vidx", "type", "x", "y", "ext_x", "ext_y", "inst_idx")


@query
def cell_task_list(spark, sf):
    return hierarchy.task_list(_placed(spark, sf)[1])


@query
def tree_dump(spark, sf):
    return hierarchy.tree_dump(_placed(spark, sf)[1])


@query
def cell_subtrees(spark, sf):
    layout, reach, ws = _cells(spark, sf)
    sized, _ = hierarchy.subtree_sizes(reach, layout.subblocks, layout.vias, ws)
    return sized.select("cell", "own_vias", "n_inst", "n_vias")


@query
def lvs_end_to_end(spark, sf):
    """The whole chain: hierarchy, placement, merging, connection, components."""
    layout, placed, ws = _design(spark, sf)
    wires = flat_wires(layout, placed, dt.ORIENTATION)
    vias = flat_vias(layout, placed.instances, dt.CONFIG)
    metals = merge.number_metals(merge.merge_intervals(wires, ws), ws)
    labels = comp.connected_components(connect.site_edges(vias, metals, dt.ORIENTATION), ws)
    return comp.component_report(comp.component_members(labels, metals))


@query
def lvs_hierarchical(spark, sf):
    """The same check from summaries of cells; components are named by their first wire."""
    layout, placed, ws = _design(spark, sf)
    return summary.hierarchical_report(layout, placed, dt.ORIENTATION, ws)


# ---------------------------------------------------------------- JSON libraries

@query
def json_shapes(spark, sf):
    cells = library.parse_cell_lines(dt.json_shape_lines(spark, sf))
    return library.wires(cells, dt.JSON_CONFIG).drop("lib")


@query
def json_shape_kinds(spark, sf):
    cells = library.parse_cell_lines(dt.json_kind_lines(spark, sf))
    return library.wires(cells, dt.JSON_CONFIG).drop("lib")


@query
def json_vias(spark, sf):
    return library.vias(library.parse_cell_lines(dt.json_via_lines(spark, sf))).select("cell", "type", "x", "y")


@query
def json_subblocks(spark, sf):
    found = library.subblocks(library.parse_cell_lines(dt.json_block_lines(spark, sf)))
    return found.select("cell", "sub_lib", "sub_cell", "name", "transform", "x", "y")


@query
def json_cell_sizes(spark, sf):
    return library.cell_sizes(library.parse_cell_lines(dt.json_cell_lines(spark, sf))).drop("lib")


# ---------------------------------------------------------------- merging

def _merged(spark, sf):
    return merge.merge_intervals(dt.placed_shapes(spark, sf), Workspace(spark))


def _metals(spark, sf, ws):
    return merge.number_metals(merge.merge_intervals(dt.placed_shapes(spark, sf), ws), ws)


@query
def merge_intervals(spark, sf):
    return _merged(spark, sf)


@query
def merged_metal_index(spark, sf):
    return _metals(spark, sf, Workspace(spark)).select("idx", "layer", "p", "s_start", "s_end", "net")


@query
def merged_net_sets(spark, sf):
    return merge.merged_nets(dt.placed_shapes(spark, sf), _metals(spark, sf, Workspace(spark)))


@query
def intra_metal_shorts(spark, sf):
    return merge.intra_metal_shorts(_merged(spark, sf))


@query
def unnamed_metals(spark, sf):
    found = merge.unnamed_metals(_merged(spark, sf))
    return found.select("layer", "p", "s_start", "s_end")


@query
def obstacle_metals(spark, sf):
    """Merged wires without a name, with one of the drawn names marking obstacles."""
    shapes = dt.placed_shapes(spark, sf).withColumn("net", F.when(F.col("net") == "N3", "OBSTACLE").otherwise(F.col("net")))
    found = merge.unnamed_metals(merge.merge_intervals(shapes, Workspace(spark)))
    return found.select("layer", "p", "s_start", "s_end", "net")


@query
def layer_counts(spark, sf):
    return merge.layer_counts(_merged(spark, sf))


@query
def remove_wires(spark, sf):
    wires = dt.cell_shapes(spark, sf).select("cell", "layer", "p", "s_start", "s_end")
    return merge.remove_wires(wires, wires.where(F.col("p") % 30 == 0).distinct())


@query
def track_depth(spark, sf):
    return sweep.track_depth(dt.placed_shapes(spark, sf), Workspace(spark))


@query
def conflict_spans(spark, sf):
    ws = Workspace(spark)
    return sweep.conflict_spans(sweep.track_depth(dt.placed_shapes(spark, sf), ws), ws)


# ---------------------------------------------------------------- connecting

def _wired(spark, sf):
    ws = Workspace(spark)
    return dt.placed_vias(spark, sf), _metals(spark, sf, ws), ws


@query
def via_metal_lookup(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return connect.via_metal_lookup(vias, metals, dt.ORIENTATION)


@query
def via_metal_lookup_closed(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return connect.via_metal_lookup(vias, metals, dt.ORIENTATION, closed=True)


@query
def metal_via_lookup(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return connect.metal_via_lookup(metals, vias, dt.ORIENTATION)


@query
def dangling_vias(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return connect.dangling_vias(vias, metals, dt.ORIENTATION)


@query
def dangling_nearest(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return sweep.dangling_nearest(vias, metals, dt.ORIENTATION)


@query
def connect_edges(spark, sf):
    vias, metals, _ = _wired(spark, sf)
    return connect.connect_edges(vias, metals, dt.ORIENTATION)


@query
def graph_adjacency(spark, sf):
    return connect.adjacency(connect_edges(spark, sf))


@query
def graph_nodes(spark, sf):
    return connect.graph_nodes(connect_edges(spark, sf))


@query
def via_order(spark, sf):
    return connect.vias_in_order(dt.placed_vias(spark, sf), Workspace(spark))


@query
def via_order_y(spark, sf):
    return connect.vias_in_order(dt.placed_vias(spark, sf), Workspace(spark), "y")


# ---------------------------------------------------------------- components and checks

def _labels(spark, sf):
    vias, metals, ws = _wired(spark, sf)
    edges = connect.site_edges(vias, metals, dt.ORIENTATION)
    return comp.connected_components(edges, ws), metals, ws


def _members(spark, sf):
    labels, metals, ws = _labels(spark, sf)
    return ws.save(comp.component_members(labels, metals), "members"), ws


@query
def connected_components(spark, sf):
    return _labels(spark, sf)[0]


@query
def component_report(spark, sf):
    labels, metals, _ = _labels(spark, sf)
    return comp.component_report(comp.component_members(labels, metals))


@query
def component_nets(spark, sf):
    return comp.component_nets(_members(spark, sf)[0])


@query
def overall_consistency(spark, sf):
    return comp.overall_consistency(component_report(spark, sf))


@query
def first_conflicts(spark, sf):
    return comp.first_conflicts(_members(spark, sf)[0])


@query
def short_paths(spark, sf):
    vias, metals, ws = _wired(spark, sf)
    edges = ws.save(connect.connect_edges(vias, metals, dt.ORIENTATION), "edges")
    labels = comp.connected_components(edges.select("u", "v"), ws)
    return trace.short_paths(edges, ws.save(comp.component_members(labels, metals), "members"), ws)


@query
def net_opens(spark, sf):
    labels, metals, ws = _labels(spark, sf)
    labels = ws.save(labels, "labels")
    lone = metals.join(labels.select("idx"), "idx", "left_anti")
    return opens.net_opens(ws.save(comp.component_members(labels, metals), "members"), metals, dt.ORIENTATION, ws, lone)


@query
def net_groups(spark, sf):
    labels, metals, _ = _labels(spark, sf)
    return comp.net_groups(labels, metals)


@query
def net_flood_fill(spark, sf):
    labels, metals, _ = _labels(spark, sf)
    return comp.net_flood_fill(labels, metals)


@query
def report_lines(spark, sf):
    members, ws = _members(spark, sf)
    return report.connectivity_lines(members, ws)


# ---------------------------------------------------------------- other outputs

@query
def net_log(spark, sf):
    labels, metals, _ = _labels(spark, sf)
    flooded = comp.net_flood_fill(labels, metals).select("net", "comp_id")
    return report.net_log_lines(flooded, comp.all_labels(labels, metals), metals)


@query
def via_records(spark, sf):
    return via_json.via_json(via_extensions(dt.placed_vias(spark, sf), dt.CONFIG))


@query
def wire_segments(spark, sf):
    return drawing.wire_segments(_merged(spark, sf), dt.ORIENTATION, {n: f"tone{n}" for n in dt.ORIENTATION if n < 5})


@query
def via_outlines(spark, sf):
    colors = {f"via_M{n}_M{n + 1}_0": f"mark{n}" for n in range(1, 4)}
    return drawing.via_outlines(via_extensions(dt.placed_vias(spark, sf), dt.CONFIG), colors, 0.5)
