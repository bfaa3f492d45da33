"""Text outputs, written by the executors as ordered part files.

``cat part-*`` of a written folder is the document; nothing is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.components import (
    component_report, first_conflicts, overall_consistency,
)
from loomtrace.operators.ordering import number_in_order
from loomtrace.workspace import Workspace

# The wires of a component are listed in blocks of this many indices, a line for each block
# that holds any, so that no text line outgrows a task.
BLOCK = 100_000

# The lines of the report.
NODES = "Total unique nodes found in graph: {}"
STARTING = "\nStarting Connectivity and Netname Consistency Check..."
BFS = "Starting BFS for new component from node (idx={})..."
SHORT = ("SHORT: Netname inconsistency! Node (idx={}) has netname '{}', "
         "but expected '{}' for this component.")
REPORT = "\n--- Connectivity Check Report ---"
FOUND = "Total connected components found: {}"
COMPONENT = "\n--- Component {} ---"
NET = "Representative Net Name: {}"
NO_NET = "None (all nodes had 'nothing' netname or component is empty)"
CONSISTENCY = "Netname Consistency: {}"
INDICES = "Metal Indices ({}): [{}"
RULE = "---------------------------------"
OVERALL = "Overall Graph Netname Consistency: {}"


def _fill(template: str, *values) -> F.Column:
    """A template as a string column."""
    parts: list = []
    pieces = template.split("{}")
    for n, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if n < len(values):
            value = values[n]
            parts.append(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts)


def connectivity_lines(members: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """(section, number, part, line): the connectivity report; order by the first three.

    Components are numbered by their least wire index.
    """
    report = number_in_order(component_report(members), ["comp_id"], "number", ws)
    report = ws.save(report, "report")
    total = overall_consistency(report)
    big = lambda v: F.lit(v).cast("bigint")

    def lines(df: DataFrame, section: int, number, part, line) -> DataFrame:
        return df.select(F.lit(section).alias("section"), number.alias("number"),
                         part.alias("part"), line.alias("line"))

    yes_no = F.when(F.col("is_consistent"), F.lit("true")).otherwise(F.lit("false"))
    head = lines(total, 0, big(0), big(0),
                 F.concat(_fill(NODES, "n_nodes"), F.lit("\n" + STARTING)))
    started = lines(report, 1, F.col("number"), big(0), _fill(BFS, "comp_id"))
    # A short is told where its component starts, after the line that opens it.
    conflicts = first_conflicts(members).join(report.select("comp_id", "number"), "comp_id")
    shorts = lines(conflicts, 1, F.col("number"), big(1), _fill(SHORT, "idx", "net", "expected"))
    found = lines(total, 2, big(0), big(0),
                  F.concat(F.lit(REPORT + "\n"), _fill(FOUND, "n_components")))
    verdict = F.when(F.col("is_consistent"), F.lit("Passed")).otherwise(F.lit("Failed"))
    blocks = lines(report, 3, F.col("number"), big(-1), F.concat(
        _fill(COMPONENT, "number"), F.lit("\n"),
        _fill(NET, F.coalesce("net", F.lit(NO_NET))), F.lit("\n"),
        _fill(CONSISTENCY, verdict),
    ))
    chunk = F.floor(F.col("idx") / block)
    sized = members.select("comp_id", "idx").join(report.select("comp_id", "number", "n_metals"), "comp_id")
    lists = sized.groupBy("comp_id", "number", "n_metals", chunk.alias("chunk")).agg(
        F.concat_ws(", ", F.sort_array(F.collect_list("idx")).cast("array<string>")).alias("list")
    )
    ends = lists.groupBy("comp_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    lists = lists.join(ends, "comp_id")
    text = F.concat(
        F.when(F.col("chunk") == F.col("first"), _fill(INDICES, "n_metals", F.lit(""))).otherwise(F.lit("")),
        "list",
        F.when(F.col("chunk") == F.col("last"), F.lit("]")).otherwise(F.lit(",")),
    )
    indices = lines(lists, 3, F.col("number"), F.col("chunk"), text)
    tail = lines(total, 4, big(0), big(0),
                 F.concat(F.lit("\n" + RULE + "\n"), _fill(OVERALL, yes_no), F.lit("\n" + RULE)))
    out = head
    for part in (started, shorts, found, blocks, indices, tail):
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write the ``line`` column in order, replacing what is at ``path``."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_connectivity_report(members: DataFrame, path: str, ws: Workspace) -> None:
    write_lines(ws.save(connectivity_lines(members, ws), "lines"), ["section", "number", "part"], path)


def _wire_text() -> F.Column:
    name = F.coalesce("net", F.lit("nothing"))
    return F.concat(F.lit("MVector(layer="), F.col("layer").cast("string"),
                    F.lit(", p_coord="), F.col("p").cast("string"),
                    F.lit(", s="), F.col("s_start").cast("string"), F.lit(":"),
                    F.col("s_end").cast("string"), F.lit(", netname="), name, F.lit(")"))


def net_log_lines(flooded: DataFrame, labelled: DataFrame, metals: DataFrame) -> DataFrame:
    """(section, net, comp_id, idx, line): each net with its groups, each group with its wires,
    then the wires without a name; order by the first four.

    ``flooded`` is (net, comp_id), ``labelled`` (comp_id, idx). A group that several nets reach
    is listed under each, but its wires are written once, so the log grows with the wires and
    with the (net, group) pairs, not with their product.
    """
    big = lambda v: F.lit(v).cast("bigint")
    none = F.lit(None).cast("string")

    def lines(df: DataFrame, section: int, net, comp_id, idx, line) -> DataFrame:
        return df.select(F.lit(section).alias("section"), net.alias("net"), comp_id.alias("comp_id"),
                         idx.alias("idx"), line.alias("line"))

    # The lines of the log.
    heads = lines(flooded.select("net").distinct(), 0, F.col("net"), big(0), big(0),
                  F.concat(F.lit("Netname: "), "net", F.lit("\nConnected groups: ")))
    groups = lines(flooded.select("net", "comp_id").distinct(), 0, F.col("net"), F.col("comp_id"), big(0),
                   _fill("Group {}", "comp_id"))
    named = flooded.select("comp_id").distinct()
    titles = lines(named, 1, none, F.col("comp_id"), big(0), _fill("\nGroup {}\nConnected MVectors: ", "comp_id"))
    wires = metals.select("idx", "layer", "p", "s_start", "s_end", "net")
    members = labelled.select("comp_id", "idx").join(named, "comp_id", "left_semi").join(wires, "idx")
    body = lines(members, 1, none, F.col("comp_id"), F.col("idx"), _wire_text())
    title = lines(metals.sparkSession.range(1), 2, none, big(0), big(0), F.lit("\nUnconnected MVectors:"))
    reason = F.when(F.col("net").isNull(), F.lit(" has no netname")).otherwise(F.lit(" has netname OBSTACLE"))
    alone = lines(wires.where(F.col("net").isNull() | (F.col("net") == "OBSTACLE")), 2, none, big(0), F.col("idx"),
                  F.concat(F.lit("MVector "), _wire_text(), reason))
    out = heads
    for part in (groups, titles, body, title, alone):
        out = out.unionByName(part)
    return out


def write_net_log(lines: DataFrame, path: str) -> None:
    write_lines(lines, ["section", "net", "comp_id", "idx"], path)
