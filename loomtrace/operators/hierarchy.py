"""Expanding the cell hierarchy into placed instances with resolved net names.

Everything that depends only on the definitions (reachability, subtree sizes, which names a
placement binds) is worked out once per cell or per subblock. Instances are then produced
level by level, each level one join of the level above with the subblocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.affine import AFFINE, compose, placement
from loomtrace.functions.nets import UNKNOWN, is_placeholder
from loomtrace.operators.ordering import running_sum_before
from loomtrace.sources.library import CELL, MICROTEMPLATES, Layout
from loomtrace.workspace import Workspace, row_count

SUB = ["sub_lib", "sub_cell"]
BLOCK = [*CELL, "ord"]
JOINT = "__"  # fixed value: between the parts of a hierarchical name


def _some(df: DataFrame) -> list:
    """A sample, for error messages."""
    return [tuple(row) for row in df.limit(5).collect()]


def usable_blocks(blocks: DataFrame, lib: str, cell: str) -> DataFrame:
    """Subblocks that become instances: below the top cell, templates do not."""
    top = (F.col("lib") == lib) & (F.col("cell") == cell)
    return blocks.where(top | ~F.col("sub_lib").contains(MICROTEMPLATES))


def reachable_cells(spark: SparkSession, lib: str, cell: str,
                    blocks_of: Callable[[list[str]], DataFrame], ws: Workspace,
                    discover: bool = True) -> DataFrame:
    """(lib, cell, depth) of the top cell and of everything below it; depth is the longest way.

    ``blocks_of(libs)`` supplies the subblocks of all libraries seen so far; it is told the
    library names of each new level, so that libraries can be read when first needed. Without
    ``discover`` the first answer holds all subblocks, and no names are gathered.
    """
    frontier = spark.createDataFrame([(lib, cell)], "lib string, cell string")
    blocks = usable_blocks(blocks_of([lib]), lib, cell)
    levels = [frontier.withColumn("depth", F.lit(0))]
    while True:
        depth = len(levels)
        below = blocks.join(frontier, CELL, "left_semi").select(
            F.col("sub_lib").alias("lib"), F.col("sub_cell").alias("cell")).distinct()
        frontier = ws.save(below, "reach")
        if row_count(frontier) == 0:
            return _union(levels).groupBy(*CELL).agg(F.max("depth").alias("depth"))
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        if depth & (depth - 1) == 0 and depth > 8 and depth > _union(levels).select(*CELL).distinct().count():
            # A way with more steps than there are cells comes back to one of them.
            raise ValueError(f"cells that contain themselves, among: {_some(frontier)}")
        if discover:
            libs = sorted(row.lib for row in frontier.select("lib").distinct().collect())
            blocks = usable_blocks(blocks_of(libs), lib, cell)


def check_cells(reach: DataFrame, cells: DataFrame) -> None:
    """Every placed cell must exist."""
    missing = _some(reach.join(cells.select(*CELL), CELL, "left_anti"))
    if missing:
        raise ValueError(f"cells not found in their libraries: {missing}")


def subtree_sizes(reach: DataFrame, blocks: DataFrame, vias: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(lib, cell, own_vias, n_inst, n_vias) of every cell, and the height of the hierarchy.

    The deepest cells come first; by its turn a cell finds all its children done.
    """
    own = reach.join(vias.groupBy(*CELL).agg(F.count(F.lit(1)).alias("own_vias")), CELL, "left").select(
        *CELL, "depth", F.coalesce("own_vias", F.lit(0)).alias("own_vias")
    )
    own = ws.save(own, "own")
    links = ws.save(blocks.groupBy(*CELL, *SUB).agg(F.count(F.lit(1)).alias("copies")), "links")
    height = own.agg(F.max("depth")).first()[0]
    sized: list[DataFrame] = []
    for depth in range(height, -1, -1):
        ready = own.where(F.col("depth") == depth)
        if sized:
            below = _union(sized).select(
                F.col("lib").alias("sub_lib"), F.col("cell").alias("sub_cell"), "n_inst", "n_vias")
            held = links.join(below, SUB).groupBy(*CELL).agg(
                F.sum(F.col("copies") * F.col("n_inst")).alias("inst"),
                F.sum(F.col("copies") * F.col("n_vias")).alias("vias"))
            ready = ready.join(held, CELL, "left")
        else:
            ready = ready.withColumns({"inst": F.lit(0), "vias": F.lit(0)})
        sized.append(ws.save(ready.select(
            *CELL, "own_vias", (1 + F.coalesce("inst", F.lit(0))).cast("bigint").alias("n_inst"),
            (F.col("own_vias") + F.coalesce("vias", F.lit(0))).cast("bigint").alias("n_vias"),
        ), "sized"))
    return _union(sized), height


def number_blocks(blocks: DataFrame, sized: DataFrame) -> DataFrame:
    """Add to every subblock how far its instance number and via numbers lie past its parent's.

    Numbers follow a depth-first walk, so the offset is what the earlier siblings hold.
    """
    child = sized.select(F.col("lib").alias("sub_lib"), F.col("cell").alias("sub_cell"), "n_inst", "n_vias")
    rows = running_sum_before(blocks.join(child, SUB), CELL, "ord",
                              {"n_inst": "_inst_before", "n_vias": "_vias_before"})
    parent = sized.select(*CELL, "own_vias")
    return rows.join(parent, CELL).select(
        *[c for c in blocks.columns],
        (1 + F.col("_inst_before")).alias("inst_offset"),
        (F.col("own_vias") + F.col("_vias_before")).alias("via_offset"),
    )


def cell_names(wires: DataFrame) -> DataFrame:
    """(lib, cell, kind, net): each name drawn in a cell, once per kind of shape."""
    return wires.where(F.col("net").isNotNull()).select(*CELL, "kind", "net").distinct()


def block_names(block_pins: DataFrame, drawn: DataFrame, blocks: DataFrame, lib: str, cell: str) -> DataFrame:
    """(lib, cell, ord, key, ref, kind): the names a subblock's instance can look up.

    kind 'pin': ``key`` is bound to the parent's name ``ref`` by the subblock's pin list;
    'label': a label of the child that no pin binds, looked up in the parent by its own name;
    'own': a pin shape of the child that nothing binds, but that the child's own subblocks
    refer to, so it names a net inside the child.
    """
    pins = block_pins.join(blocks.select(*BLOCK), BLOCK, "left_semi").groupBy(
        *BLOCK, F.col("term").alias("key")
    ).agg(F.min("net").alias("ref"), F.max("net").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("one terminal bound to two nets: "), "key")).cast("string")
    pins = pins.select(
        *BLOCK, "key", F.when(F.col("ref") == F.col("_other"), F.col("ref")).otherwise(clash).alias("ref"),
        F.lit("pin").alias("kind"),
    )

    def names_of_children(kind: str) -> DataFrame:
        names = drawn.where(F.col("kind") == kind).select(
            F.col("lib").alias("sub_lib"), F.col("cell").alias("sub_cell"), F.col("net").alias("key")
        )
        return blocks.select(*BLOCK, *SUB).join(names, SUB)

    labels = names_of_children("label").join(pins, [*BLOCK, "key"], "left_anti").select(
        *BLOCK, "key", F.col("key").alias("ref"), F.lit("label").alias("kind")
    )
    bound = pins.unionByName(labels)
    unbound = (names_of_children("pin").where(~is_placeholder(F.col("key")))
               .join(bound, [*BLOCK, "key"], "left_anti"))
    used = bound.where((F.col("lib") != lib) | (F.col("cell") != cell)).select(
        F.col("lib").alias("sub_lib"), F.col("cell").alias("sub_cell"), F.col("ref").alias("key"),
        F.lit(True).alias("_used"),
    ).distinct()
    lost = F.raise_error(F.concat(F.lit("pin shape bound to no net: "), "sub_cell", F.lit("/"), "key"))
    own = unbound.join(used, [*SUB, "key"], "left").select(
        *BLOCK, "key", F.when(F.col("_used"), F.col("key")).otherwise(lost.cast("string")).alias("ref"),
        F.lit("own").alias("kind"),
    )
    return bound.unionByName(own)


@dataclass(frozen=True)
class Instances:
    """instances: idx, parent_idx, path, depth, lib, cell, inst_name, m_name, a..ty, width, height, via_base
    scope: idx, lib, cell, a..ty, key, net   (what each name means inside an instance)
    """

    instances: DataFrame
    scope: DataFrame


@dataclass(frozen=True)
class Expanded:
    """The levels of instances, top first, with what binding names needs; saved tables all."""

    levels: list[DataFrame]
    blocks: DataFrame

    @property
    def instances(self) -> DataFrame:
        return _union([level.drop(*PARENT) for level in self.levels])


PARENT = ["_lib", "_cell", "_ord", "_parent_name"]


def _top_level(cells: DataFrame, lib: str, cell: str) -> DataFrame:
    """The top cell as an instance."""
    identity = {"a": 1, "b": 0, "c": 0, "d": 1, "tx": 0, "ty": 0}
    big = lambda v: F.lit(v).cast("bigint")
    return cells.where((F.col("lib") == lib) & (F.col("cell") == cell)).select(
        big(1).alias("idx"), big(None).alias("parent_idx"), F.array(F.lit(0)).alias("path"),
        F.lit(0).alias("depth"), *CELL, F.lit(cell).alias("inst_name"), F.lit(cell).alias("m_name"),
        *[big(v).alias(n) for n, v in identity.items()], big(0).alias("via_base"), "width", "height",
    )


def expand_instances(layout: Layout, reach: DataFrame, lib: str, cell: str, ws: Workspace) -> Expanded:
    """All instances below one top cell, each level one join of the level above with the subblocks."""
    usable = ws.save(usable_blocks(layout.subblocks, lib, cell).join(reach, CELL, "left_semi"), "usable")
    sized, height = subtree_sizes(reach, usable, layout.vias, ws)
    sizes = layout.cells.select(*CELL, "width", "height")
    moves = placement(F.col("transform"), F.col("x"), F.col("y"))
    blocks = ws.save(
        number_blocks(usable, sized).select(
            *BLOCK, *SUB, "name", "inst_offset", "via_offset", *[c.alias(f"c_{n}") for n, c in moves.items()])
        .join(sizes.withColumnsRenamed({"lib": "sub_lib", "cell": "sub_cell"}), SUB),
        "blocks",
    )
    levels = [ws.save(_top_level(layout.cells, lib, cell), "level")]
    for depth in range(1, height + 1):
        joined = levels[-1].drop("width", "height", *PARENT).join(blocks, CELL)
        moved = compose({n: F.col(n) for n in AFFINE}, {n: F.col(f"c_{n}") for n in AFFINE})
        levels.append(ws.save(joined.select(
            (F.col("idx") + F.col("inst_offset")).alias("idx"), F.col("idx").alias("parent_idx"),
            F.concat("path", F.array("ord")).alias("path"), F.lit(depth).alias("depth"),
            F.col("sub_lib").alias("lib"), F.col("sub_cell").alias("cell"),
            F.col("name").alias("inst_name"), F.concat_ws(JOINT, "m_name", "name").alias("m_name"),
            *[c.alias(n) for n, c in moved.items()],
            (F.col("via_base") + F.col("via_offset")).alias("via_base"), "width", "height",
            F.col("lib").alias("_lib"), F.col("cell").alias("_cell"), F.col("ord").alias("_ord"),
            F.col("m_name").alias("_parent_name"),
        ), "level"))
    return Expanded(levels, usable)


def bind_names(layout: Layout, expanded: Expanded, lib: str, cell: str, ws: Workspace,
               strict_null: bool = False) -> DataFrame:
    """(idx, lib, cell, a..ty, key, net): what each name means inside each instance.

    A terminal bound to no net gets a name made up from the parent's below the first level,
    as any other unbound name does; with ``strict_null`` it stays unknown everywhere.
    """
    drawn = ws.save(cell_names(layout.wires), "drawn")
    names = ws.save(block_names(layout.block_pins, drawn, expanded.blocks, lib, cell), "names")
    binds = names.withColumnsRenamed({"lib": "_lib", "cell": "_cell", "ord": "_ord"})
    own = drawn.select(*CELL, F.col("net").alias("key")).distinct()
    top = expanded.levels[0].join(own, CELL)  # in the top cell every name means itself
    scopes = [ws.save(top.select("idx", *CELL, *AFFINE, "key", F.col("key").alias("net")), "scope")]
    for depth, level in enumerate(expanded.levels[1:], start=1):
        asked = level.join(binds, ["_lib", "_cell", "_ord"])
        inside = F.concat_ws(JOINT, "m_name", "key")
        if depth == 1:
            # The top cell knows every name; unbound labels of its children stay theirs.
            net = F.when(F.col("kind") == "pin", F.col("ref")).otherwise(inside)
        else:
            outer = scopes[-1].select(F.col("idx").alias("parent_idx"), F.col("key").alias("ref"),
                                      F.col("net").alias("_net"))
            asked = asked.join(outer, ["parent_idx", "ref"], "left")
            net = F.when(F.col("kind") == "own", inside).otherwise(
                F.coalesce("_net", F.concat_ws(JOINT, "_parent_name", "ref"))
            )
        if strict_null:
            net = F.when(F.col("ref") == UNKNOWN, F.lit(UNKNOWN)).otherwise(net)
        scopes.append(ws.save(asked.select("idx", *CELL, *AFFINE, "key", net.alias("net")), "scope"))
    return _union(scopes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build_instances(layout: Layout, reach: DataFrame, lib: str, cell: str, ws: Workspace,
                    strict_null: bool = False) -> Instances:
    """From the definitions of the reachable cells to instances and their scopes."""
    expanded = expand_instances(layout, reach, lib, cell, ws)
    return Instances(expanded.instances, bind_names(layout, expanded, lib, cell, ws, strict_null))


def tree_dump(instances: DataFrame) -> DataFrame:
    """(idx, line): the hierarchy as indented text, one line per instance; order by ``idx``."""
    return instances.select("idx", F.concat(F.repeat(F.lit("  "), F.col("depth")), "cell").alias("line"))


def task_list(instances: DataFrame) -> DataFrame:
    """(lib, cell, depth): each placed cell once; by falling depth, children precede parents."""
    return instances.groupBy(*CELL).agg(F.max("depth").alias("depth"))
