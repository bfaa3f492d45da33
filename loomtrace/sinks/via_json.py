"""Vias as JSON lines, one folder per via type, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "xy array<bigint>, extension array<bigint>, layer array<string>, type string"


def via_points(vias: DataFrame) -> DataFrame:
    """(type, xy, extension, layer): one via per row, as it is written."""
    return vias.select(
        "type",
        F.array("x", "y").alias("xy"),
        F.array("ext_x", "ext_y").cast("array<bigint>").alias("extension"),
        F.array(F.concat(F.lit("M"), F.col("lower").cast("string")),
                F.concat(F.lit("M"), F.col("upper").cast("string"))).alias("layer"),
    )


def via_json(vias: DataFrame) -> DataFrame:
    """(type, vpoint): each via's JSON record; a type's records are never gathered in one row."""
    record = F.to_json(F.struct("xy", "extension", "layer", "type"))
    return via_points(vias).select("type", record.alias("vpoint"))


def write_via_json(vias: DataFrame, path: str) -> None:
    points = via_points(vias).withColumn("_type", F.col("type"))
    points.write.mode("overwrite").partitionBy("_type").json(path)


def read_via_json(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_via_json`` wrote."""
    return spark.read.schema(_POINT).json(path + "/_type=*")


def read_grouped_via_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {type: {"type": ..., "vpoints": [...]}} as via rows.

    The document is one value, so one task parses it; the rows are spread afterwards.
    """
    doc = f"map<string, struct<type: string, vpoints: array<struct<{_POINT}>>>>"
    rows = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", doc, {"mode": "FAILFAST"})).alias("key", "group")
    )
    return rows.select(F.explode("group.vpoints").alias("v")).select("v.*")
