"""Via type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a via type names the two layers it joins.
VIA_TYPE = r"via_M(\d+)_M(\d+)_\d+"


def via_layers(via_type: Column) -> tuple[Column, Column]:
    """The two layer numbers of a via type; a name of another form raises."""
    bad = F.raise_error(F.concat(F.lit("invalid via type: "), via_type)).cast("int")
    def part(group: int) -> Column:
        return F.when(via_type.rlike(VIA_TYPE),
                      F.regexp_extract(via_type, VIA_TYPE, group).cast("int")).otherwise(bad)

    return part(1), part(2)
