"""Placements as six-number affine maps: x' = a*x + b*y + tx, y' = c*x + d*y + ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placement name -> (a, b, c, d).
ORIENTATIONS = {
    "R0": (1, 0, 0, 1),
    "R90": (0, -1, 1, 0),
    "R180": (-1, 0, 0, -1),
    "R270": (0, 1, -1, 0),
    "MX": (1, 0, 0, -1),
    "MY": (-1, 0, 0, 1),
    "MXY": (0, 1, 1, 0),
}

AFFINE = ("a", "b", "c", "d", "tx", "ty")


def placement(transform: Column, x: Column, y: Column) -> dict[str, Column]:
    """The affine map of one placement; an unknown transform name raises."""
    def entry(position: int) -> Column:
        value = F.raise_error(F.concat(F.lit("unknown transform: "), transform)).cast("bigint")
        for name, matrix in ORIENTATIONS.items():
            value = F.when(transform == name, F.lit(matrix[position]).cast("bigint")).otherwise(value)
        return value

    return {"a": entry(0), "b": entry(1), "c": entry(2), "d": entry(3), "tx": x, "ty": y}


def compose(outer: dict[str, Column], inner: dict[str, Column]) -> dict[str, Column]:
    """``outer`` after ``inner``."""
    o, i = outer, inner
    return {
        "a": o["a"] * i["a"] + o["b"] * i["c"],
        "b": o["a"] * i["b"] + o["b"] * i["d"],
        "c": o["c"] * i["a"] + o["d"] * i["c"],
        "d": o["c"] * i["b"] + o["d"] * i["d"],
        "tx": o["a"] * i["tx"] + o["b"] * i["ty"] + o["tx"],
        "ty": o["c"] * i["tx"] + o["d"] * i["ty"] + o["ty"],
    }


def apply_point(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["tx"], m["c"] * x + m["d"] * y + m["ty"]


def apply_track(m: dict[str, Column], vertical: Column, p: Column, s_start: Column,
                s_end: Column) -> dict[str, Column]:
    """Move a wire that stays on its axis.

    A quarter turn would put the wire on the other axis, where its layer has no tracks;
    such a placement is an error.
    """
    turned = (m["b"] != 0) | (m["c"] != 0)
    stop = F.raise_error(F.lit("quarter-turn placement: wires would leave their axis")).cast("bigint")
    across = F.when(turned, stop).otherwise(F.when(vertical, m["a"]).otherwise(m["d"]))
    along = F.when(vertical, m["d"]).otherwise(m["a"])
    p_shift = F.when(vertical, m["tx"]).otherwise(m["ty"])
    s_shift = F.when(vertical, m["ty"]).otherwise(m["tx"])
    e0, e1 = along * s_start + s_shift, along * s_end + s_shift
    return {"p": across * p + p_shift, "s_start": F.least(e0, e1), "s_end": F.greatest(e0, e1)}


def apply_rect(m: dict[str, Column], x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Move both corners of a rectangle, under any placement."""
    (ax, ay), (bx, by) = apply_point(m, x0, y0), apply_point(m, x1, y1)
    return {"x0": ax, "y0": ay, "x1": bx, "y1": by}
