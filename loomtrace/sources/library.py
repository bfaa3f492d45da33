"""Cell libraries: JSON in, long tables out, and a parquet store in between.

A library file is one JSON document ``{lib: {cell: {...}}}``. Files are parsed in parallel,
one task each; from then on every table is split by cell. ``write_store`` keeps the long
tables as parquet, so a large design is parsed once and later runs start from columnar scans.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.layers import exact_long, layer_number, track_columns, is_vertical
from loomtrace.functions.nets import unify
from loomtrace.sources.config import TechConfig

# One type for all kinds, so that their lists go together; names of primitives' pins and metals are not used.
_RECT = "layer string, xy array<array<double>>, hextension double, vextension double, netname string"
_CELL = f"""struct<
  bbox: array<array<double>>,
  subblocks: array<struct<libname: string, cellname: string, name: string, transform: string,
    xy: array<double>, pins: map<string, struct<termname: string, netname: string>>>>,
  primitives: array<struct<pins: map<string, struct<{_RECT}>>>>,
  metals: array<struct<{_RECT}>>,
  labels: array<struct<{_RECT}>>,
  pins: array<struct<{_RECT}>>,
  vias: array<struct<cellname: string, xy: array<double>, layer: array<string>>>
>"""

CELL = ["lib", "cell"]

# Fixed value: libraries with this in their name hold device templates, whose shapes the
# parent lists as primitives.
MICROTEMPLATES = "_microtemplates_"


@dataclass(frozen=True)
class Layout:
    """The definition side of a design, as long tables keyed by (lib, cell).

    cells       lib, cell, width, height, complete
    subblocks   lib, cell, ord, sub_lib, sub_cell, name, transform, x, y
    block_pins  lib, cell, ord, term, net      (net names already unified)
    wires       lib, cell, kind, layer, p, s_start, s_end, net  (net null: unnamed)
    vias        lib, cell, ord, type, x, y
    """

    cells: DataFrame
    subblocks: DataFrame
    block_pins: DataFrame
    wires: DataFrame
    vias: DataFrame


def read_libraries(spark: SparkSession, db_dir: str, libs: list[str]) -> DataFrame:
    """(lib, cell, c): one row per cell of the named libraries."""
    paths = [f"{db_dir}/{lib}_db.json" for lib in libs]
    # Spark shows file names as they stand in an address: a space as %20.
    shown = {spark._jvm.org.apache.hadoop.fs.Path(f"{lib}_db.json").toUri().getRawPath(): lib for lib in libs}
    file_lib = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    docs = spark.read.text(paths, wholetext=True).select(
        file_lib[F.col("_metadata.file_name")].alias("file_lib"),
        F.from_json("value", f"map<string, map<string, {_CELL}>>", {"mode": "FAILFAST"}).alias("doc"),
    )
    return (
        docs.select("file_lib", F.explode("doc").alias("lib", "content"))
        .where(F.col("file_lib") == F.col("lib"))
        .select("lib", F.explode("content").alias("cell", "c"))
    )


def parse_cell_lines(lines: DataFrame) -> DataFrame:
    """(lib, cell, c) of ``lines`` (value): a JSON object {lib, cell, content} on each line.

    In this form a library is split over tasks, and a cell may be spread over several lines.
    """
    row = F.from_json("value", f"lib string, cell string, content {_CELL}", {"mode": "FAILFAST"})
    return lines.select(row.alias("row")).select("row.lib", "row.cell", F.col("row.content").alias("c"))


def read_cell_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_cell_lines(spark.read.text(path))


def _xy(shape: str, point: int, axis: int):
    return exact_long(F.col(shape)["xy"][point][axis])


def wires(cells: DataFrame, config: TechConfig) -> DataFrame:
    """Every wire of every cell: primitive pins and metals unnamed, labels and pins named.

    The four lists of a cell become rows in one pass, so a library is parsed once.
    """
    prim_pins = F.flatten(F.transform("c.primitives", lambda d: F.coalesce(F.map_values(d["pins"]), F.array())))
    lists = (("primitive", False, prim_pins), ("metal", False, F.col("c.metals")),
             ("label", True, F.col("c.labels")), ("pin", True, F.col("c.pins")))
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(named).alias("named"), shapes.alias("shapes"))
                      for kind, named, shapes in lists])
    rows = cells.select(*CELL, F.explode(lists).alias("k")).select(
        *CELL, "k.kind", "k.named", F.explode("k.shapes").alias("r"))
    rows = rows.select(
        *CELL, "kind", "named", layer_number(F.col("r.layer")).alias("layer"),
        _xy("r", 0, 0).alias("x0"), _xy("r", 0, 1).alias("y0"),
        _xy("r", 1, 0).alias("x1"), _xy("r", 1, 1).alias("y1"),
        exact_long(F.col("r.hextension")).alias("hext"),
        exact_long(F.col("r.vextension")).alias("vext"),
        F.col("r.netname").alias("net"),
    )
    rows = unify(rows, "net", config.aliases).withColumn("net", F.when(F.col("named"), F.col("net")))
    rows = rows.withColumn("vertical", is_vertical(F.col("layer"), config.orientation))
    track = track_columns(*[F.col(c) for c in ("vertical", "x0", "y0", "x1", "y1", "hext", "vext")])
    return rows.select(*CELL, "kind", "layer", *[c.alias(n) for n, c in track.items()], "net")


def vias(cells: DataFrame) -> DataFrame:
    rows = cells.select(*CELL, F.posexplode("c.vias").alias("ord", "v"))
    return rows.select(
        *CELL, "ord", F.col("v.cellname").alias("type"),
        exact_long(F.col("v.xy")[0]).alias("x"), exact_long(F.col("v.xy")[1]).alias("y"),
    )


def via_extensions(via_rows: DataFrame, config: TechConfig) -> DataFrame:
    """Add ``ext_x, ext_y``; a via type without a config entry raises.

    The check sits on ``type``, so it also runs where the extensions are not read.
    """
    found = via_rows.join(config.via_types(via_rows.sparkSession), "type", "left")
    missing = F.raise_error(F.concat(F.lit("via type not in the config: "), "type")).cast("string")
    return found.withColumn("type", F.when(F.col("ext_x").isNotNull(), F.col("type")).otherwise(missing))


def subblocks(cells: DataFrame) -> DataFrame:
    rows = cells.select(*CELL, F.posexplode("c.subblocks").alias("ord", "b"))
    return rows.select(
        *CELL, "ord",
        F.col("b.libname").alias("sub_lib"), F.col("b.cellname").alias("sub_cell"),
        F.col("b.name").alias("name"), F.col("b.transform").alias("transform"),
        exact_long(F.col("b.xy")[0]).alias("x"), exact_long(F.col("b.xy")[1]).alias("y"),
    )


def block_pins(cells: DataFrame, config: TechConfig) -> DataFrame:
    rows = cells.select(*CELL, F.posexplode("c.subblocks").alias("ord", "b")).select(
        *CELL, "ord", F.explode("b.pins").alias("pin", "p")
    )
    rows = rows.select(*CELL, "ord", F.col("p.termname").alias("term"), F.col("p.netname").alias("net"))
    return unify(unify(rows, "term", config.aliases), "net", config.aliases)


def cell_sizes(cells: DataFrame) -> DataFrame:
    def span(axis: int):
        bbox = F.col("c.bbox")
        return exact_long(bbox[1][axis]) - exact_long(bbox[0][axis])

    complete = F.lit(True)
    for part in ("primitives", "metals", "labels", "pins", "vias"):
        complete = complete & F.col(f"c.{part}").isNotNull()
    return cells.select(*CELL, span(0).alias("width"), span(1).alias("height"), complete.alias("complete"))


def layout_of(cells: DataFrame, config: TechConfig) -> Layout:
    return Layout(cell_sizes(cells), subblocks(cells), block_pins(cells, config),
                  wires(cells, config), vias(cells))


def write_store(layout: Layout, path: str) -> None:
    for part in fields(Layout):
        getattr(layout, part.name).write.mode("overwrite").parquet(f"{path}/{part.name}")


def read_store(spark: SparkSession, path: str) -> Layout:
    return Layout(*[spark.read.parquet(f"{path}/{part.name}") for part in fields(Layout)])
