"""Net names: placeholders and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A missing name, and the name of blockage shapes.
UNKNOWN = "UNKNOWN"
OBSTACLE = "OBSTACLE"


def or_unknown(net: Column) -> Column:
    return F.coalesce(net, F.lit(UNKNOWN))


def is_placeholder(net: Column) -> Column:
    return net.isin(UNKNOWN, OBSTACLE)


def known(net: Column) -> Column:
    """The name if it names something, else null."""
    return F.when(net != UNKNOWN, net)


def alias_map(equivalent_sets: list[list[str]]) -> dict[str, str]:
    """alias -> representative (the first name of its set).

    A name in two sets has no order-independent meaning, so it is rejected.
    """
    out: dict[str, str] = {}
    for names in equivalent_sets:
        for name in names:
            if out.setdefault(name, names[0]) != names[0]:
                raise ValueError(f"net name {name!r} is in two equivalence sets")
    return out


def unify(df: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Replace missing names by the placeholder and aliases by their representative.

    The aliases come from the config, which the driver holds, so they are sent to all tasks; the
    few names that rows have would not deal the rows to more than a few.
    """
    df = df.withColumn(column, or_unknown(F.col(column)))
    changed = {name: rep for name, rep in aliases.items() if name != rep}
    if not changed:
        return df
    table = df.sparkSession.createDataFrame(list(changed.items()), "_alias string, _rep string")
    return (
        df.join(F.broadcast(table), df[column] == table["_alias"], "left")
        .withColumn(column, F.coalesce("_rep", column))
        .drop("_alias", "_rep")
    )
