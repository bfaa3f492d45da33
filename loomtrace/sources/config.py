"""Runset and technology config files (YAML, a few dozen lines each), from a local path or one that Spark reads."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from loomtrace.functions.nets import alias_map


@dataclass(frozen=True)
class Runset:
    """What to check and where its files are."""

    libname: str
    cellname: str
    db_dir: str
    log_dir: str
    config_file_path: str
    metal_dir: str | None = None
    via_dir: str | None = None
    visualized_dir: str | None = None
    netlog_dir: str | None = None

    @property
    def report_path(self) -> str:
        return f"{self.log_dir}/{self.libname}_{self.cellname}.out"


@dataclass(frozen=True)
class TechConfig:
    """Layer orientation, via extensions and net aliases."""

    orientation: dict[int, bool]  # layer number -> wires run vertically
    via_extension: dict[str, tuple[int, int]]
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def max_layer(self) -> int:
        return max(self.orientation)

    def layers(self, spark: SparkSession) -> DataFrame:
        rows = sorted(self.orientation.items())
        return spark.createDataFrame(rows, "layer int, vertical boolean")

    def via_types(self, spark: SparkSession) -> DataFrame:
        rows = [(name, *ext) for name, ext in sorted(self.via_extension.items())]
        return spark.createDataFrame(rows, "type string, ext_x int, ext_y int")

    def net_aliases(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.aliases.items()), "name string, rep string")


def _is_remote(path: str) -> bool:
    return "://" in path


def read_yaml(path: str) -> dict:
    if _is_remote(path):
        return yaml.safe_load(SparkSession.active().read.text(path, wholetext=True).first()["value"])
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def read_runset(path: str) -> Runset:
    data = read_yaml(path)
    missing = [k for k in ("libname", "cellname", "db_dir", "log_dir", "config_file_path") if k not in data]
    if missing:
        raise KeyError(f"runset {path} lacks {', '.join(missing)}")
    known = {k: v for k, v in data.items() if k in Runset.__dataclass_fields__}
    runset = Runset(**known)
    database = f"{runset.db_dir}/{runset.libname}_db.json"
    # What is missing in a remote folder is found by the scan that asks for it.
    if not _is_remote(runset.db_dir) and not os.path.isfile(database):
        raise FileNotFoundError(f"database file {database} not found")
    if not _is_remote(runset.config_file_path) and not os.path.isfile(runset.config_file_path):
        raise FileNotFoundError(f"config file {runset.config_file_path} not found")
    return runset


def layer_key(name: str) -> int:
    """Driver-side twin of ``functions.layers.layer_number`` for the config's own layers."""
    return int(name.lower().replace("metal", "").replace("m", "").strip())


def read_config(path: str) -> TechConfig:
    data = read_yaml(path)
    for key in ("Layer", "Via"):
        if key not in data:
            raise KeyError(f"config {path} must have a {key!r} section")
    order, marks = data["Layer"]["order"], data["Layer"]["orientation"]
    if len(marks) < len(order):
        raise ValueError("Layer.orientation is shorter than Layer.order")
    # Fixed value: a pipe marks vertical layers.
    orientation = {layer_key(name): mark == "|" for name, mark in zip(order, marks)}
    extension = {name: tuple(int(v) for v in via["extension"]) for name, via in data["Via"].items()}
    return TechConfig(orientation, extension, alias_map(data.get("Equivalent_net_sets") or []))
