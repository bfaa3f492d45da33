"""The four stages, from a runset file to the checked design.

Each stage returns DataFrames. They read intermediate tables under the session's checkpoint
folder, which stay there until the returned object's ``close()``.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.vias import VIA_TYPE
from loomtrace.operators.components import (
    component_members, component_report, connected_components, overall_consistency,
)
from loomtrace.operators.connect import site_edges
from loomtrace.operators.flatten import flat_vias, flat_wires
from loomtrace.operators.hierarchy import Instances, build_instances, check_cells, reachable_cells
from loomtrace.operators.merge import merge_intervals, number_metals
from loomtrace.sinks.report import write_connectivity_report
from loomtrace.sources.config import Runset, TechConfig, read_config, read_runset
from loomtrace.sources.library import (
    CELL, Layout, layout_of, read_libraries, read_store, subblocks, write_store,
)
from loomtrace.workspace import Workspace, row_count

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Database:
    """The expanded design."""

    runset: Runset
    config: TechConfig
    layout: Layout
    placed: Instances
    workspace: Workspace

    @property
    def instances(self) -> DataFrame:
        return self.placed.instances

    @property
    def scope(self) -> DataFrame:
        return self.placed.scope

    def close(self) -> None:
        self.workspace.close()


@dataclass(frozen=True)
class Flat:
    database: Database
    metals: DataFrame
    vias: DataFrame


@dataclass(frozen=True)
class Merged:
    flat: Flat
    metals: DataFrame

    def count(self) -> int:
        return self.metals.count()


@dataclass(frozen=True)
class Checked:
    """The result of a run: one row per component, and its members."""

    merged: Merged
    components: DataFrame
    members: DataFrame
    overall: DataFrame

    def is_consistent(self) -> bool:
        return self.overall.first()["is_consistent"]


class _Libraries:
    """Reads libraries as the hierarchy walk first meets them."""

    def __init__(self, spark: SparkSession, db_dir: str, ws: Workspace):
        self.spark, self.db_dir, self.ws = spark, db_dir, ws
        self.loaded: set[str] = set()
        self.cells: DataFrame | None = None

    def blocks_of(self, libs: list[str]) -> DataFrame:
        new = sorted(set(libs) - self.loaded)
        if new:
            batch = self.ws.save(read_libraries(self.spark, self.db_dir, new), "cells")
            found = {row.lib for row in batch.select("lib").distinct().collect()}
            if set(new) - found:
                raise ValueError(f"libraries not found in their files: {sorted(set(new) - found)}")
            self.cells = batch if self.cells is None else self.cells.unionByName(batch)
            self.loaded |= set(new)
        return subblocks(self.cells)


def _check_complete(layout: Layout) -> None:
    bad = layout.cells.where(~F.col("complete")).select(*CELL).limit(5).collect()
    if bad:
        raise KeyError(f"cells without one of primitives, metals, labels, pins, vias: {bad}")


def _check_via_types(layout: Layout, config: TechConfig) -> None:
    """The config must know every via type in use, and its name must say which layers it joins."""
    types = layout.vias.select("type").distinct()
    known = config.via_types(types.sparkSession).select("type", F.lit(True).alias("known"))
    bad = types.join(known, "type", "left").where(
        F.col("known").isNull() | ~F.col("type").rlike(VIA_TYPE)
    ).limit(5).collect()
    for row in bad:
        raise ValueError(f"invalid via type: {row.type!r}" if row.known
                         else f"via type not in the config: {row.type!r}")


def load_db(path_runset: str, spark: SparkSession | None = None, store: str | None = None,
            strict: bool = False, strict_null: bool = False) -> Database:
    """Read the libraries and expand the hierarchy; an error leaves no tables behind.

    With ``store``, the parquet tables of an earlier ``ingest`` replace the JSON libraries.
    ``strict_null`` keeps terminals that are bound to no net unnamed on every level.
    """
    spark = spark or SparkSession.active()
    runset = read_runset(path_runset)
    config = read_config(runset.config_file_path)
    ws = Workspace(spark)
    try:
        return _load(spark, runset, config, ws, store, strict, strict_null)
    except BaseException:
        ws.close()
        raise


def _load(spark: SparkSession, runset: Runset, config: TechConfig, ws: Workspace, store: str | None,
          strict: bool, strict_null: bool) -> Database:
    lib, cell = runset.libname, runset.cellname
    if store is None:
        libraries = _Libraries(spark, runset.db_dir, ws)
        reach = reachable_cells(spark, lib, cell, libraries.blocks_of, ws)
        check_cells(reach, libraries.cells)
        layout = layout_of(libraries.cells.join(reach, CELL, "left_semi"), config)
        # Unpacked from the nested cells once; names, plain and named wires all read it.
        layout = replace(layout, wires=ws.save(layout.wires, "wires"))
    else:
        full = read_store(spark, store)
        reach = reachable_cells(spark, lib, cell, lambda libs: full.subblocks, ws, False)
        check_cells(reach, full.cells)
        parts = {name: getattr(full, name).join(reach, CELL, "left_semi")
                 for name in Layout.__dataclass_fields__}
        layout = Layout(**parts)
    if strict:
        _check_complete(layout)
        _check_via_types(layout, config)
    placed = build_instances(layout, reach, lib, cell, ws, strict_null=strict_null)
    log.info("%s/%s: expanded", lib, cell)
    return Database(runset, config, layout, placed, ws)


def ingest(path_runset: str, store: str, spark: SparkSession | None = None) -> None:
    """Parse the libraries of a design once into parquet tables under ``store``."""
    spark = spark or SparkSession.active()
    runset = read_runset(path_runset)
    config = read_config(runset.config_file_path)
    ws = Workspace(spark)
    try:
        libraries = _Libraries(spark, runset.db_dir, ws)
        reach = reachable_cells(spark, runset.libname, runset.cellname, libraries.blocks_of, ws)
        check_cells(reach, libraries.cells)
        write_store(layout_of(libraries.cells.join(reach, CELL, "left_semi"), config), store)
    finally:
        ws.close()


def flatten(path_runset: str, spark: SparkSession | None = None, store: str | None = None,
            strict_null: bool = False) -> Flat:
    """All wires and vias of the design in top coordinates."""
    db = load_db(path_runset, spark, store, True, strict_null)
    wires = flat_wires(db.layout, db.placed, db.config.orientation)
    return Flat(db, wires, flat_vias(db.layout, db.placed.instances, db.config))


def merge_vector(path_runset: str, spark: SparkSession | None = None, store: str | None = None,
                 strict_null: bool = False) -> Merged:
    """Overlapping and touching wires of a track merged, named and numbered."""
    flat = flatten(path_runset, spark, store, strict_null)
    ws = flat.database.workspace
    return Merged(flat, number_metals(merge_intervals(flat.metals, ws), ws))


def run_lvs(path_runset: str, spark: SparkSession | None = None, store: str | None = None,
            closed: bool = False, strict_null: bool = False, write: bool = True) -> Checked:
    """The whole check; writes the report to ``{log_dir}/{lib}_{cell}.out``.

    ``closed`` also accepts a via on the very start of a wire.
    """
    merged = merge_vector(path_runset, spark, store, strict_null)
    db = merged.flat.database
    ws = db.workspace
    edges = site_edges(merged.flat.vias, merged.metals, db.config.orientation, closed)
    labels = connected_components(edges, ws)
    members = ws.save(component_members(labels, merged.metals), "members")
    components = component_report(members)
    log.info("%d wires in the connection graph", row_count(members))
    if write:
        write_connectivity_report(members, db.runset.report_path, ws)
        log.info("report written to %s", db.runset.report_path)
    return Checked(merged, components, members, overall_consistency(components))
