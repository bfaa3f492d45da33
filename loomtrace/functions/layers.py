"""Layer names, layer orientation, and track coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layer_number(name: Column) -> Column:
    """``M3`` / ``Metal3`` -> 3; anything that does not end up numeric raises."""
    digits = F.trim(F.regexp_replace(F.lower(name), "(metal|m)", ""))
    return digits.cast("int")


def layer_title(layer: Column) -> Column:
    """3 -> ``Metal3``."""
    return F.concat(F.lit("Metal"), layer.cast("string"))


def is_vertical(layer: Column, orientation: dict[int, bool], strict: bool = True) -> Column:
    """Orientation of a layer number under the technology config.

    The config has a handful of layers, so this is a literal membership test rather than
    a join. A layer outside the config raises when ``strict``, and is null otherwise.
    """
    vertical = [n for n, v in orientation.items() if v]
    horizontal = [n for n, v in orientation.items() if not v]
    unknown = (
        F.raise_error(F.concat(F.lit("layer not in the config: "), layer.cast("string")))
        if strict
        else F.lit(None)
    ).cast("boolean")
    return (
        F.when(layer.isin(vertical), F.lit(True))
        .when(layer.isin(horizontal), F.lit(False))
        .otherwise(unknown)
    )


def exact_long(value: Column) -> Column:
    """A JSON number as BIGINT; a fractional coordinate is an error, never rounded."""
    return F.when(value == F.floor(value), value.cast("bigint")).when(
        value.isNotNull(),
        F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string"))).cast("bigint"),
    )


def track_columns(vertical: Column, x0: Column, y0: Column, x1: Column, y1: Column,
                  hext: Column, vext: Column) -> dict[str, Column]:
    """A rectangle as a wire on a track: ``p`` across the wire, ``s_start..s_end`` along it.

    Only the first point fixes the track, and only the extension along the wire counts.
    """
    ext = F.when(vertical, vext).otherwise(hext)
    s0 = F.when(vertical, y0).otherwise(x0)
    s1 = F.when(vertical, y1).otherwise(x1)
    return {
        "p": F.when(vertical, x0).otherwise(y0),
        "s_start": F.least(s0, s1) - ext,
        "s_end": F.greatest(s0, s1) + ext,
    }
