"""Sweeps along tracks: how many wires and names lie on each stretch, and what lies next to a point.

A track may hold any share of all rows, so no window runs along a whole track. Tracks are cut
into tiles; a window sees one tile, and what it needs from the tiles before is carried in one
row per tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.nets import known
from loomtrace.operators.connect import endpoints, locate
from loomtrace.operators.merge import TRACK, merge_intervals
from loomtrace.workspace import Workspace

TILE_BITS = 16


def _carried(rows: DataFrame, group: list[str], at: str, value: str, inclusive: Column | None, bits: int) -> DataFrame:
    """``rows`` with ``value`` of the last row before, by ``at``, where it is not null.

    ``inclusive`` orders rows of one ``at``: what comes first there is seen by what follows.
    """
    tile = F.shiftright(at, bits).alias("_tile")
    rows = rows.withColumn("_tile", tile)
    order = [F.col(at)] if inclusive is None else [F.col(at), inclusive]
    inside = Window.partitionBy(*group, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tiles = Window.partitionBy(*group).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*group, "_tile").agg(
        F.max(F.when(F.col(value).isNotNull(), F.struct(at, value))).alias("_end"))
    ends = ends.select(*group, "_tile", F.last(f"_end.{value}", True).over(tiles).alias("_carry"))
    here = F.last(value, True).over(inside).alias("_here")
    return rows.select("*", here).join(ends, [*group, "_tile"]).withColumn(
        "_before", F.coalesce("_here", "_carry")).drop("_here", "_carry", "_tile")


def last_before(points: DataFrame, marks: DataFrame, group: list[str], at: str, value: str, out: str,
                inclusive: bool = False, bits: int | None = None) -> DataFrame:
    """``points`` with ``out``: ``value`` of the last of ``marks`` (*group, at, value) before each, else null.

    An as-of join as one sort of both sides. Marks at the very place of a point count if
    ``inclusive``. Of several marks at one place the greatest value counts.
    """
    best = marks.groupBy(*group, at).agg(F.max(value).alias("_mark"))
    own = F.struct(*points.columns)
    both = points.select(*group, at, own.alias("_point"), F.lit(None).cast(marks.schema[value].dataType).alias("_mark")
                         ).unionByName(best.withColumn("_point", F.lit(None).cast(
                             points.select(own.alias("p")).schema["p"].dataType)))
    marks_first = F.col("_mark").isNull() if inclusive else F.col("_mark").isNotNull()
    found = _carried(both, group, at, "_mark", marks_first, bits or TILE_BITS)
    return found.where(F.col("_point").isNotNull()).select("_point.*", F.col("_before").alias(out))


def dangling_nearest(vias: DataFrame, metals: DataFrame, orientation: dict[int, bool]) -> DataFrame:
    """(vidx, layer, left_idx, left_gap, right_idx, right_gap) of each via end that meets no wire.

    ``left`` is the last wire on the end's track that ends before it, ``right`` the first that
    starts at it or after it; both are null where there is none. A wire's own start does not
    join a via there, so such an end has a gap of 0 to the right. Ends on layers without an
    orientation have no track and no row. Ends and wires are sorted together by tile; which ends
    meet a wire, and what lies on either side of the others, comes from that.
    """
    ends = endpoints(vias.select("vidx", "lower", "upper", "x", "y"), orientation, once=True)
    ends = ends.select("vidx", *TRACK, "s").where(F.col("p").isNotNull())
    none = F.lit(None).cast("bigint")
    starts = metals.select(none.alias("vidx"), *TRACK, F.col("s_start").alias("s"),
                           F.struct("s_end", "idx").alias("_ended"), F.struct(F.col("s_start").alias("s"), "idx").alias("_wire"))
    no_wire = [F.lit(None).cast(starts.schema[n].dataType).alias(n) for n in ("_ended", "_wire")]
    tile = F.shiftright("s", TILE_BITS).alias("_tile")
    places = ends.select("*", *no_wire).unionByName(starts).select("*", tile)
    # Of the wires that start before an end, the one that reaches furthest either covers it or is the last before it.
    order = [F.col("s"), F.col("_wire").isNotNull()]
    inside, along = Window.partitionBy(*TRACK, "_tile"), Window.partitionBy(*TRACK).orderBy("_tile")
    so_far = Window.unboundedPreceding, -1
    tiles = places.groupBy(*TRACK, "_tile").agg(F.max("_ended").alias("_ended"), F.min("_wire").alias("_wire")).select(
        *TRACK, "_tile", F.max("_ended").over(along.rowsBetween(*so_far)).alias("_left"),
        F.min("_wire").over(Window.partitionBy(*TRACK).orderBy(F.desc("_tile")).rowsBetween(*so_far)).alias("_right"))
    found = places.select(
        "*", F.max("_ended").over(inside.orderBy(*order).rowsBetween(*so_far)).alias("left"),
        F.min("_wire").over(inside.orderBy(*[o.desc() for o in order]).rowsBetween(*so_far)).alias("right"),
    ).where(F.col("_wire").isNull()).drop("_ended", "_wire")
    found = found.join(tiles, [*TRACK, "_tile"]).select(
        "vidx", "layer", "s", F.greatest("left", "_left").alias("left"), F.coalesce("right", "_right").alias("right"))
    missed = found.where(F.col("left").isNull() | (F.col("left.s_end") < F.col("s")))
    return missed.select("vidx", "layer", F.col("left.idx").alias("left_idx"), (F.col("s") - F.col("left.s_end")).alias("left_gap"),
                         F.col("right.idx").alias("right_idx"), (F.col("right.s") - F.col("s")).alias("right_gap"))


def track_depth(shapes: DataFrame, ws: Workspace) -> DataFrame:
    """(layer, p, s_start, s_end, depth, n_nets): every stretch between two neighbouring wire ends on a track.

    ``depth`` wires lie on the stretch, with ``n_nets`` different known names; stretches without
    any are left out, and so are wires without length, which lie on none. Wires are events (one
    more at the start, one less at the end), summed up by place before they are sorted; the
    wires of one name are merged first, so that each name is one wire at most.
    """
    long = shapes.where(F.col("s_start") < F.col("s_end"))
    by_name = long.select("p", "s_start", "s_end", F.struct("layer", known(F.col("net")).alias("net")).alias("layer"),
                          F.lit(None).cast("string").alias("net")).where(F.col("layer.net").isNotNull())
    names = merge_intervals(by_name, ws).select(F.col("layer.layer").alias("layer"), "p", "s_start", "s_end")

    def events(wires: DataFrame, wire: int, name: int) -> DataFrame:
        end = F.explode(F.array(F.struct(F.col("s_start").alias("s"), F.lit(1).alias("n")),
                                F.struct(F.col("s_end").alias("s"), F.lit(-1).alias("n")))).alias("e")
        return wires.select(*TRACK, end).select(
            *TRACK, "e.s", (F.col("e.n") * wire).alias("wires"), (F.col("e.n") * name).alias("names"))

    steps = events(long, 1, 0).unionByName(events(names, 0, 1)).groupBy(*TRACK, "s").agg(
        F.sum("wires").alias("wires"), F.sum("names").alias("names"))
    # One sort per tile gives sums and neighbours; what lies beyond its tile comes in one row per tile.
    steps = steps.withColumn("_tile", F.shiftright("s", TILE_BITS))
    inside = Window.partitionBy(*TRACK, "_tile").orderBy("s")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*TRACK).orderBy("_tile")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    tiles = steps.groupBy(*TRACK, "_tile").agg(
        F.sum("wires").alias("wires"), F.sum("names").alias("names"), F.min("s").alias("first")
    ).select(*TRACK, "_tile", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in ("wires", "names")],
             F.lead("first").over(along).alias("_next"))
    local = steps.select(*TRACK, "_tile", F.col("s").alias("s_start"), F.lead("s").over(inside).alias("s_end"),
                         F.sum("wires").over(so_far).alias("wires"), F.sum("names").over(so_far).alias("names"))
    return local.join(tiles, [*TRACK, "_tile"]).select(
        "layer", "p", "s_start", F.coalesce("s_end", "_next").alias("s_end"),
        (F.col("_wires") + F.col("wires")).alias("depth"), (F.col("_names") + F.col("names")).alias("n_nets"),
    ).where("depth > 0")


def conflict_spans(depths: DataFrame, ws: Workspace) -> DataFrame:
    """(layer, p, s_start, s_end, max_nets): where on a wire two or more names lie on each other."""
    several = ws.save(depths.where("n_nets > 1"), "several")
    spans = merge_intervals(several.withColumn("net", F.lit(None).cast("string")), ws).withColumn(
        "idx", F.monotonically_increasing_id())
    spans = ws.save(spans.select("idx", "layer", "p", "s_start", "s_end"), "spans")
    most = locate(several.select("layer", "p", F.col("s_end").alias("s"), "n_nets"), spans).groupBy("idx").agg(
        F.max("n_nets").alias("max_nets"))
    return spans.join(most, "idx").select("layer", "p", "s_start", "s_end", "max_nets")
