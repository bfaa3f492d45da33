"""A layout read out of the TPC-H-style tables: suppliers are cells, line items wires,
orders vias, and region > nation > supplier the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.flatten import place_shapes, place_vias
from loomtrace.operators.ordering import running_sum_before
from loomtrace.sources.config import TechConfig
from loomtrace.sources.library import Layout

# Layers 1..5, odd ones vertical, as in the shipped technology config.
ORIENTATION = {1: True, 2: False, 3: True, 4: False, 5: True}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(value) -> F.Column:
    return value.cast("bigint")


def _sign(key, negative: tuple[int, int]) -> F.Column:
    return F.when((key % 4).isin(*negative), F.lit(-1)).otherwise(F.lit(1))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One placed cell per supplier, with its composed placement."""
    region = table(spark, sf_dir, "region").select("r_regionkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    r, n, s = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    return rows.select(
        s.alias("cell"),
        _long(_sign(r, (1, 3)) * _sign(n, (1, 3)) * _sign(s, (1, 3))).alias("a"),
        F.lit(0).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("c"),
        _long(_sign(r, (1, 2)) * _sign(n, (1, 2)) * _sign(s, (1, 2))).alias("d"),
        _long(s * 5000).alias("tx"),
        _long(r * 100000 + n * 1000).alias("ty"),
    )


def cell_shapes(spark: SparkSession, sf_dir: str, extra: list[F.Column] = ()) -> DataFrame:
    """One wire per line item, in the coordinates of its cell."""
    s0 = (F.col("l_orderkey") % 40) * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        (1 + F.col("l_linenumber") % 5).cast("int").alias("layer"),
        _long((F.col("l_partkey") % 40) * 10).alias("p"),
        _long(s0).alias("s_start"),
        _long(s0 + F.col("l_quantity").cast("bigint")).alias("s_end"),
        F.when(F.col("l_returnflag") == "R",
               F.concat(F.lit("N"), (F.col("l_partkey") % 7).cast("string"))).alias("net"),
        *extra,
    )


def cell_vias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One via per order, in the coordinates of its cell."""
    n_cells = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    key = F.col("o_orderkey")
    lower = (1 + key % 4).cast("int")
    return table(spark, sf_dir, "orders").select(
        key.alias("vidx"),
        (F.col("o_custkey") % n_cells).alias("cell"),
        F.concat(F.lit("via_M"), lower.cast("string"), F.lit("_M"), (lower + 1).cast("string"),
                 F.lit("_0")).alias("type"),
        _long((F.col("o_custkey") % 40) * 10).alias("x"),
        _long(((key % 397) * 10) % 400).alias("y"),
    )


def placed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_shapes(cell_shapes(spark, sf_dir), instances(spark, sf_dir), ["cell"], ORIENTATION)


def placed_vias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_vias(cell_vias(spark, sf_dir), instances(spark, sf_dir), ["cell"])


LIB, CHIP = "geo", "chip"
CONFIG = TechConfig(ORIENTATION, {f"via_M{n}_M{n + 1}_0": (10, 10 + n) for n in range(1, 5)})


def _cell(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _turn(key) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in ("R0", "R180", "MX", "MY")]), (key % 4 + 1).cast("int"))


def hierarchy(spark: SparkSession, sf_dir: str) -> Layout:
    """The same shapes as a real hierarchy: chip > region > nation > supplier."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    key, zero, text = F.col("key"), F.lit(0).cast("bigint"), lambda v: F.lit(v).cast("string")

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.lit(LIB).alias("lib"), _cell(prefix, key).alias("cell"),
                         _long(1000 + key).alias("width"), _long(key * 10).alias("height"),
                         F.lit(True).alias("complete"))

    def blocks(df: DataFrame, cell, prefix: str, x, y) -> DataFrame:
        return df.select(F.lit(LIB).alias("lib"), cell.alias("cell"), key.cast("int").alias("ord"),
                         F.lit(LIB).alias("sub_lib"), _cell(prefix, key).alias("sub_cell"),
                         _cell(prefix.lower(), key).alias("name"), _turn(key).alias("transform"),
                         _long(x).alias("x"), _long(y).alias("y"))

    def pins(df: DataFrame, cell, bound: list[tuple[str, F.Column]]) -> DataFrame:
        entry = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), n.alias("net")) for t, n in bound]))
        return df.select(F.lit(LIB).alias("lib"), cell.alias("cell"), key.cast("int").alias("ord"),
                         entry.alias("e")).select("lib", "cell", "ord", "e.*").where(F.col("net") != "-")

    def marks(df: DataFrame, cell, net, p) -> DataFrame:
        return df.select(F.lit(LIB).alias("lib"), cell.alias("cell"), F.lit("label").alias("kind"),
                         F.lit(1).alias("layer"), _long(p).alias("p"), zero.alias("s_start"),
                         F.lit(5).cast("bigint").alias("s_end"), net.alias("net"))

    chip, in_region, in_nation = F.lit(CHIP), _cell("R", F.col("n_regionkey")), _cell("N", F.col("s_nationkey"))
    one = spark.range(1).select(F.lit(0).alias("key"))
    all_cells = (
        cells(one, "chip").withColumn("cell", F.lit(CHIP))
        .unionByName(cells(region, "R")).unionByName(cells(nation, "N")).unionByName(cells(supplier, "S"))
    )
    all_blocks = (
        blocks(region, chip, "R", zero, key * 100000)
        .unionByName(blocks(nation, in_region, "N", zero, key * 1000))
        .unionByName(blocks(supplier, in_nation, "S", key * 5000, zero))
    )
    same = lambda *names: [(n, F.lit(n)) for n in names]
    all_pins = (
        pins(region, chip, [("IN", _cell("X", key % 2)), *same("VDD:")])
        .unionByName(pins(nation, in_region, [("OUT", _cell("M", key % 3)), *same("IN", "VDD:")]))
        .unionByName(pins(supplier, in_nation, [
            ("Q", _cell("K", key % 5)), *same("IN", "OUT", "VDD:"),
            ("Z", F.when(key % 2 == 0, F.lit("UNKNOWN")).otherwise(F.lit("-"))),
        ]))
    )
    net = F.element_at(F.array(*[F.lit(n) for n in ("IN", "OUT", "Q", "VDD:", "L4", "L5", "UNKNOWN")]),
                       (F.col("l_partkey") % 7 + 1).cast("int"))
    named = F.col("l_returnflag") == "R"
    pin = F.col("l_partkey") % 7 < 4
    shapes = cell_shapes(spark, sf_dir, extra=[
        F.when(named, net).alias("name"),
        F.when(named, F.when(pin, F.lit("pin")).otherwise(F.lit("label"))).otherwise(F.lit("metal")).alias("kind"),
    ])
    all_wires = (
        shapes.select(F.lit(LIB).alias("lib"), _cell("S", F.col("cell")).alias("cell"), "kind", "layer",
                      "p", "s_start", "s_end", F.col("name").alias("net"))
        .unionByName(marks(region, _cell("R", key), text("L6"), key * 10))
        .unionByName(marks(nation, _cell("N", key), text("L5"), key * 10))
        .unionByName(marks(region.select((key % 2).alias("key")).distinct(), chip, _cell("X", key), key * 10))
    )
    vias = cell_vias(spark, sf_dir)
    all_vias = running_sum_before(
        vias.select(F.lit(LIB).alias("lib"), _cell("S", F.col("cell")).alias("cell"), "vidx", "type", "x", "y",
                    F.lit(1).alias("one")),
        ["lib", "cell"], "vidx", {"one": "ord"},
    ).select("lib", "cell", "ord", "type", "x", "y")
    return Layout(all_cells, all_blocks, all_pins, all_wires, all_vias)


# Documents of one cell hold the rows of this many orders (or suppliers) each, so that no cell
# becomes one row.
PART = 1024
ALIASES = {"N1": "PWR", "N2": "PWR"}
JSON_CONFIG = TechConfig(ORIENTATION, CONFIG.via_extension, ALIASES)


def _lines(df: DataFrame, part: F.Column, **content: F.Column) -> DataFrame:
    """(value): a JSON line per cell and part; ``content`` names what the line's cell lists."""
    rows = df.groupBy("cell", part.alias("part")).agg(*[c.alias(n) for n, c in content.items()])
    body = F.struct(*content)
    return rows.select(F.to_json(F.struct(F.lit(LIB).alias("lib"), "cell", body.alias("content"))).alias("value"))


def _track_rect() -> list[F.Column]:
    """A line item as a track rectangle, drawn from its far end to its near one; 5 more on either side."""
    s0, p = (F.col("l_orderkey") % 40) * 10, (F.col("l_partkey") % 40) * 10
    vertical = (F.col("l_linenumber") % 5) % 2 == 0
    s1 = s0 + F.col("l_quantity").cast("bigint")

    def end(s) -> F.Column:
        return F.when(vertical, F.array(p.cast("double"), s.cast("double"))).otherwise(
            F.array(s.cast("double"), p.cast("double")))

    return [F.concat(F.lit("M"), (1 + F.col("l_linenumber") % 5).cast("string")).alias("layer"),
            F.array(end(s1), end(s0)).alias("xy"), F.lit(5).alias("hextension"), F.lit(5).alias("vextension")]


def json_shape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wires as a cell library: one track rectangle per line item, named ones as labels."""
    rect = _track_rect()
    name = F.when(F.col("l_partkey") % 7 > 0, _cell("N", F.col("l_partkey") % 7))
    rows = table(spark, sf_dir, "lineitem").select(
        _cell("S", F.col("l_suppkey")).alias("cell"), "l_orderkey", (F.col("l_returnflag") == "R").alias("named"),
        F.struct(*rect).alias("metal"), F.struct(*rect, name.alias("netname")).alias("label"))
    return _lines(
        rows, F.floor(F.col("l_orderkey") / PART),
        metals=F.collect_list(F.when(~F.col("named"), F.col("metal"))),
        labels=F.collect_list(F.when(F.col("named"), F.col("label"))))


def json_kind_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wires of all four kinds, pins of primitives among them; a third of the names mark obstacles."""
    rect, kind = _track_rect(), F.col("l_partkey") % 4
    name = (F.when(F.col("l_orderkey") % 3 == 0, F.lit("OBSTACLE"))
            .when(F.col("l_orderkey") % 3 == 1, _cell("N", F.col("l_partkey") % 7)))
    rows = table(spark, sf_dir, "lineitem").select(
        _cell("S", F.col("l_suppkey")).alias("cell"), "l_orderkey", kind.alias("kind"),
        F.struct(F.create_map(F.lit("D"), F.struct(*rect)).alias("pins")).alias("primitive"),
        F.struct(*rect).alias("metal"), F.struct(*rect, name.alias("netname")).alias("named"))
    own = lambda n, column: F.collect_list(F.when(F.col("kind") == n, F.col(column)))
    return _lines(rows, F.floor(F.col("l_orderkey") / PART), primitives=own(0, "primitive"), metals=own(1, "metal"),
                  labels=own(2, "named"), pins=own(3, "named"))


def template_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subblocks of nations' cells; every third supplier is a device template of another library."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.lit(LIB).alias("lib"), _cell("N", F.col("s_nationkey")).alias("cell"), key.cast("int").alias("ord"),
        F.when(key % 3 == 0, "dev_microtemplates_x").otherwise(LIB).alias("sub_lib"), _cell("S", key).alias("sub_cell"))


def json_via_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cell_vias(spark, sf_dir).select(
        _cell("S", F.col("cell")).alias("cell"), "vidx",
        F.struct(F.col("type").alias("cellname"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("xy"))
        .alias("via"))
    return _lines(rows, F.floor(F.col("vidx") / PART), vias=F.collect_list("via"))


def json_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        _cell("N", F.col("s_nationkey")).alias("cell"), "s_suppkey",
        F.struct(F.lit(LIB).alias("libname"), _cell("S", key).alias("cellname"), _cell("s", key).alias("name"),
                 _turn(key).alias("transform"),
                 F.array((key * 5000).cast("double"), (-key).cast("double")).alias("xy")).alias("block"))
    return _lines(rows, F.floor(key / PART), subblocks=F.collect_list("block"))


def json_cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes; every third cell lacks its list of vias."""
    key = F.col("s_suppkey")
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    none = F.array().cast("array<struct<layer:string>>")
    content = F.struct(
        F.array(point(key, F.lit(0)), point(2 * key + 1000, key * 10)).alias("bbox"),
        *[none.alias(n) for n in ("primitives", "metals", "labels", "pins")],
        F.when(key % 3 != 0, none).alias("vias"))
    return table(spark, sf_dir, "supplier").select(F.to_json(F.struct(
        F.lit(LIB).alias("lib"), _cell("S", key).alias("cell"), content.alias("content"))).alias("value"))
