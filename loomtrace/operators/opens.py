"""Opens: nets whose wires fall into several groups, and the narrowest gap between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.layers import is_vertical
from loomtrace.operators.components import component_nets
from loomtrace.workspace import Workspace, row_count

LEVEL_STEP = 2  # squares grow by this many bits a round
LEAST_BITS = 10  # the last search uses squares of 2**10 grid units at least, so that long wires cover few


def _segments(wires: DataFrame, orientation: dict[int, bool]) -> DataFrame:
    """Wires as segments: x0, y0, x1, y1 in place of layer, p, s_start, s_end."""
    vertical = is_vertical(F.col("layer"), orientation)
    return wires.select(
        *[c for c in wires.columns if c not in ("layer", "p", "s_start", "s_end")],
        *[F.when(vertical, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in
          (("x0", "p", "s_start"), ("y0", "s_start", "p"), ("x1", "p", "s_end"), ("y1", "s_end", "p"))])


def _bounds(wires: DataFrame, nets: DataFrame, ws: Workspace) -> DataFrame:
    """(net, bound, least): a distance that two wires' ends of different groups keep to.

    Ends are gathered in squares of growing size until each of ``nets`` has a square with two
    groups; squares hold one row a group, so a round is smaller than the one before. A square of
    one point proves a gap of 0, and ``least`` is the least wire that has an end in such a square;
    it is null where the bound is above 0. Squares count from the net's least coordinates, so that
    in the end one square holds all.
    """
    end = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")),
                            F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")
    squares = wires.select("net", "part", "idx", end).select("net", "part", "idx", "e.x", "e.y")
    found, n_found, bits = None, 0, 0
    while n_found < row_count(nets):
        least = F.min("idx") if bits == 0 else F.lit(None).cast("bigint")
        shared = squares.groupBy("net", "x", "y").agg(
            F.min("part").alias("a"), F.max("part").alias("b"), least.alias("idx")).where("a <> b")
        met = ws.save(shared.groupBy("net").agg(F.min("idx").alias("least")).select(
            "net", F.lit(2 * ((1 << bits) - 1)).cast("bigint").alias("bound"), "least"), "met")
        found = met if found is None else found.unionByName(met)
        n_found += row_count(met)
        if n_found < row_count(nets):
            rest = nets.select("net").join(found.select("net"), "net", "left_anti")
            if bits == 0:
                corner = wires.groupBy("net").agg(F.min("x0").alias("left"), F.min("y0").alias("low"))
                squares = squares.join(corner.join(rest, "net"), "net").select(
                    "net", "part", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("low")).alias("y"))
            else:
                squares = squares.join(rest, "net", "left_semi")
            bits += LEVEL_STEP
            up = [F.shiftright(c, LEVEL_STEP).alias(c) for c in "xy"]
            squares = ws.save(squares.select("net", "part", *up).distinct(), "squares")
    return found


def net_opens(members: DataFrame, metals: DataFrame, orientation: dict[int, bool], ws: Workspace,
              lone: DataFrame | None = None) -> DataFrame:
    """(net, n_parts, gap, idx_a, idx_b): each open net and the two wires nearest to each other.

    ``members`` lists all groups (``all_labels``), single wires included; ``lone`` takes those
    wires of ``metals`` that are groups of their own and left out of ``members``, which need no
    join. The gap is the distance along x plus that along y between two wires of different groups,
    whatever their layers: 0 where they cross without a via. Ties go to the least ``idx_a``, then
    ``idx_b``. A net whose groups were all joined by others' names still counts by groups. Nets on
    one group have no row.

    A first bound comes from the wires' ends, in squares that grow until two groups share one.
    Then each wire meets later ones in the squares, as large as the bound, that it or a border of
    that width around it covers. Where two wires with a gap of 0 are known, only wires up to the
    first of them can still come first, so no others look around. Squares with one group only are
    left before anything is joined, so wires meet only where another group is as near as the bound.
    """
    place = _segments(metals.drop("net"), orientation)
    names = ws.save(component_nets(members).select("net", F.col("comp_id").alias("part")), "parts")
    wires = ws.save(
        members.select(F.col("comp_id").alias("part"), "idx").join(place, "idx").join(names, "part")
        .select("net", "part", "idx", "x0", "y0", "x1", "y1"), "segments")
    if lone is not None:
        alone = ws.save(_segments(lone.where(F.col("net").isNotNull()), orientation).select(
            "net", F.col("idx").alias("part"), "idx", "x0", "y0", "x1", "y1"), "alone")
        names = names.unionByName(alone.select("net", "part"))
        wires = wires.unionByName(alone)
    nets = ws.save(names.groupBy("net").agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1"), "open-nets")
    bounds = _bounds(wires, nets, ws)
    if bounds is None:
        return nets.select("net", "n_parts", *[F.lit(0).cast("bigint").alias(c) for c in ("gap", "idx_a", "idx_b")])
    bits = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.col("bound") + 1)).cast("int")).alias("bits")
    sized = wires.join(bounds.select("net", "bound", "least", bits), "net")
    square = ["net", "cx", "cy"]

    def squares(rows: DataFrame, border: Column) -> DataFrame:
        rows = rows.withColumn("border", border)
        for axis in "xy":
            rows = rows.withColumn(f"c{axis}", F.explode(F.expr(
                f"sequence(shiftright({axis}0 - border, bits), shiftright({axis}1 + border, bits))")))
        return rows.select(*square, "part", "idx", "x0", "y0", "x1", "y1")

    first = ws.save(squares(sized.where("least is null or idx <= least"), F.col("bound")), "wide")
    others = ws.save(squares(sized, F.lit(0)).join(first.select(*square).distinct(), square, "left_semi"), "near")
    busy = ws.save(first.select(*square, "part").unionByName(others.select(*square, "part")).groupBy(*square)
                   .agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select(*square), "busy")
    b = others.join(busy, square, "left_semi").select(
        *square, *[F.col(c).alias(f"b_{c}") for c in ("part", "idx", "x0", "y0", "x1", "y1")])
    pairs = first.join(busy, square, "left_semi").join(b, square).where("part <> b_part and idx < b_idx")
    apart = [F.greatest(F.lit(0), F.greatest(f"{c}0", f"b_{c}0") - F.least(f"{c}1", f"b_{c}1")) for c in "xy"]
    near = pairs.select("net", (apart[0] + apart[1]).alias("gap"), F.col("idx").alias("idx_a"), F.col("b_idx").alias("idx_b"))
    best = near.groupBy("net").agg(F.min(F.struct("gap", "idx_a", "idx_b")).alias("best"))
    return nets.join(best, "net").select("net", "n_parts", "best.*")
