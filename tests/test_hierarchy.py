"""Net names and placements against a recursive definition, on random designs; and the errors."""

import os
import random

import pytest

import loomtrace
from layouts import CONFIG, DEMO, block, cell, rect, via
from loomtrace.plans.pipeline import load_db
from loomtrace.operators.hierarchy import build_instances, reachable_cells
from loomtrace.sources.config import read_config, read_runset
from loomtrace.sources.library import layout_of, read_libraries, subblocks
from loomtrace.workspace import Workspace

ALIASES = {n: s[0] for s in CONFIG["Equivalent_net_sets"] for n in s}
TURNS = {"R0": (1, 1), "R180": (-1, -1), "MX": (1, -1), "MY": (-1, 1)}


def unified(name):
    return "UNKNOWN" if name is None else ALIASES.get(name, name)


def meaning(chain, key):
    """What ``key`` means in the last instance of ``chain``, asked from the inside out.

    A chain is a list of (hierarchical name, {terminal: net}, labels) from the top down.
    """
    name, pins, labels = chain[-1]
    depth = len(chain) - 1
    if depth == 0:
        return key
    if key in pins:
        return pins[key] if depth == 1 else outer(chain[:-1], pins[key])
    if key in labels:
        return f"{name}__{key}" if depth == 1 else outer(chain[:-1], key)
    return None


def outer(chain, key):
    found = meaning(chain, key)
    return f"{chain[-1][0]}__{key}" if found is None else found


def random_design(rng):
    names = ["A", "B", "C", "vdd", "VDD", "gnd", None]
    cells = {}
    for level in (3, 2, 1, 0):
        for copy in range(1 if level == 0 else 2):
            below = [c for c in cells if c.startswith(f"c{level + 1}") or (level < 2 and c.startswith("c3"))]
            blocks = []
            for n in range(rng.randint(0, 3) if below and level else (3 if level == 0 else 0)):
                bound = {unified(t): (t, rng.choice(names)) for t in rng.sample(["A", "B", "VDD", "gnd"], 2)}
                blocks.append(block("lib", rng.choice(below), f"i{n}", rng.choice(list(TURNS)),
                                    (rng.randint(-50, 50), rng.randint(-50, 50)), bound.values()))
            labels = [rect("M1", 0, 0, 0, 5, 0, rng.choice(names)) for _ in range(rng.randint(0, 2))]
            cells[f"c{level}_{copy}"] = cell(blocks, labels=labels, vias=[via("via_M1_M2_0", 0, 0)] * rng.randint(0, 2))
    return cells


def walk(cells, name, chain, place, out):
    a, d, tx, ty = place
    entry = len(out)
    out.append((chain, place, name))
    for sub in cells[name]["subblocks"]:
        sa, sd = TURNS[sub["transform"]]
        x, y = sub["xy"]
        pins = {unified(p["termname"]): unified(p["netname"]) for p in sub["pins"].values()}
        labels = {unified(r["netname"]) for r in cells[sub["cellname"]]["labels"]}
        step = (f"{chain[-1][0]}__{sub['name']}", pins, labels)
        walk(cells, sub["cellname"], chain + [step], (a * sa, d * sd, a * x + tx, d * y + ty), out)
    return entry


@pytest.mark.parametrize("seed", [1, 3])
def test_random_designs(spark, design, seed):
    cells = random_design(random.Random(seed))
    runset = design({"lib": cells}, "lib", "c0_0")
    ws = Workspace(spark)
    run = read_runset(runset)
    raw = ws.save(read_libraries(spark, run.db_dir, ["lib"]), "cells")
    layout = layout_of(raw, read_config(run.config_file_path))
    reach = reachable_cells(spark, "lib", "c0_0", lambda libs: subblocks(raw), ws)
    placed = build_instances(layout, reach, "lib", "c0_0", ws)
    expected = []
    walk(cells, "c0_0", [("c0_0", {}, set())], (1, 1, 0, 0), expected)
    rows = placed.instances.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(1, len(expected) + 1))
    assert [(r["m_name"], r["cell"], r["a"], r["d"], r["tx"], r["ty"]) for r in rows] == [
        (chain[-1][0], name, *place) for chain, place, name in expected]
    scope = {(r["idx"], r["key"]): r["net"] for r in placed.scope.collect()}
    assert len(scope) == placed.scope.count()
    want = {}
    for n, (chain, _, name) in enumerate(expected, 1):
        if n == 1:
            keys = {unified(r["netname"]) for r in cells[name]["labels"]}
        else:
            keys = set(chain[-1][1]) | chain[-1][2]
        want.update({(n, k): meaning(chain, k) for k in keys})
    assert scope == want
    first_via = 0
    for row, (_, _, name) in zip(rows, expected):
        assert row["via_base"] == first_via
        first_via += len(cells[name]["vias"])
    ws.close()


def run(spark, runset):
    result = loomtrace.run_lvs(runset, spark, write=False)
    out = result.merged.flat.metals.collect(), result.components.collect()
    result.merged.flat.database.close()
    return out


def fails(spark, runset, text):
    with pytest.raises(Exception, match=text):
        run(spark, runset)


def test_templates_become_instances_only_in_the_top_cell(spark, design):
    tpl = {"nmos": cell(metals=[rect("M1", 5, 0, 5, 9)])}
    mid = cell([block("a_microtemplates_b", "nmos", "T")])
    top = cell([block("main", "mid", "M"), block("a_microtemplates_b", "nmos", "T")])
    db = loomtrace.load_db(design({"main": {"mid": mid, "top": top}, "a_microtemplates_b": tpl}, "main", "top"), spark)
    names = [r["m_name"] for r in db.instances.orderBy("idx").collect()]
    assert names == ["top", "top__M", "top__T"]
    db.close()


def test_libraries_are_loaded_as_they_are_reached(spark, design):
    other = {"leaf": cell(metals=[rect("M2", 0, 3, 9, 3)]), "unused": cell([block("absent", "x", "X")])}
    metals, _ = run(spark, design({"main": {"top": cell([block("other", "leaf", "L")])}, "other": other}, "main", "top"))
    assert [tuple(r) for r in metals] == [(2, 3, 0, 9, None, 2)]


def test_unbound_pin_shape_of_a_cell_with_internal_use(spark, design):
    leaf = cell(labels=[rect("M1", 0, 0, 0, 5, 0, "Z")])
    mid = cell([block("m", "leaf", "L", pins=[("Z", "N")])], pins=[rect("M1", 3, 0, 3, 5, 0, "N")])
    metals, _ = run(spark, design({"m": {"leaf": leaf, "mid": mid, "top": cell([block("m", "mid", "M")])}}, "m", "top"))
    assert sorted(r["net"] for r in metals) == ["top__M__N", "top__M__N"]


def test_errors(spark, design, tmp_path):
    inner = cell(metals=[rect("M1", 0, 0, 0, 5)])
    one = lambda b, **extra: {"m": {"inner": inner, "top": cell([b], **extra)}}
    fails(spark, design(one(block("m", "inner", "I", "R90")), "m", "top"), "quarter-turn")
    fails(spark, design(one(block("m", "inner", "I", "R45")), "m", "top"), "unknown transform")
    fails(spark, design(one(block("m", "nope", "I")), "m", "top"), "not found")
    fails(spark, design(one(block("m", "inner", "I")), "m", "nope"), "not found")
    fails(spark, design(one(block("m", "top", "I")), "m", "top"), "contain themselves")
    fails(spark, design(one(block("m", "inner", "I", xy=(0.5, 0))), "m", "top"), "whole number")


def test_errors_in_shapes_and_nets(spark, design):
    top = lambda **parts: {"m": {"top": cell(**parts)}}
    fails(spark, design(top(vias=[{"cellname": "via_M1_M9_0", "xy": [0, 0], "layer": ["M1", "M9"]}]), "m", "top"),
          "not in the config")
    odd = {**CONFIG, "Via": {**CONFIG["Via"], "contact": {"map": [], "extension": [1, 1]}}}
    fails(spark, design(top(vias=[{"cellname": "contact", "xy": [0, 0], "layer": []}]), "m", "top", odd),
          "invalid via type")
    fails(spark, design(top(metals=[rect("M9", 0, 0, 0, 5)]), "m", "top"), "not in the config")
    fails(spark, design(top(metals=[rect("poly", 0, 0, 0, 5)]), "m", "top"), "CAST_INVALID_INPUT")
    lone = cell(pins=[rect("M1", 3, 0, 3, 5, 0, "N")])
    fails(spark, design({"m": {"lone": lone, "top": cell([block("m", "lone", "L")])}}, "m", "top"), "bound to no net")
    twice = cell([block("m", "lone", "L", pins=[("VDD", "A"), ("vdd", "B"), ("N", "N")])])
    fails(spark, design({"m": {"lone": lone, "top": twice}}, "m", "top"), "bound to two nets")
    broken = dict(DEMO["inv"])
    del broken["metals"]
    with pytest.raises(KeyError, match="primitives"):
        loomtrace.flatten(design({"m": {"top": broken}}, "m", "top"), spark)


def test_config_errors(spark, design, tmp_path):
    good = design({"demo": DEMO}, "demo", "top")
    for key in ("Layer", "Via"):
        path = design({"demo": DEMO}, "demo", "top", {k: v for k, v in CONFIG.items() if k != key})
        with pytest.raises(KeyError, match=key):
            read_config(read_runset(path).config_file_path)
    clash = design({"demo": DEMO}, "demo", "top", {**CONFIG, "Equivalent_net_sets": [["A", "x"], ["B", "x"]]})
    with pytest.raises(ValueError, match="two equivalence sets"):
        read_config(read_runset(clash).config_file_path)
    (tmp_path / "db" / "demo_db.json").rename(tmp_path / "db" / "gone.json")
    with pytest.raises(FileNotFoundError):
        read_runset(good)


def test_config_and_libraries_in_a_remote_store(spark, design, tmp_path):
    """All paths are addresses that only Spark opens."""
    runset = design({"demo": DEMO}, "demo", "top")
    text = open(runset).read().replace(str(tmp_path), f"file://{tmp_path}")
    open(runset, "w").write(text)
    db = load_db(f"file://{runset}", spark)
    assert db.config.max_layer == 5 and db.instances.count() > 1
    db.close()


def test_config_tables(spark, design):
    config = read_config(read_runset(design({"demo": DEMO}, "demo", "top")).config_file_path)
    assert config.max_layer == 5
    assert config.orientation == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert {tuple(r) for r in config.layers(spark).collect()} == set(config.orientation.items())
    assert config.via_types(spark).count() == 8
    assert ("gnd", "VSS:") in {tuple(r) for r in config.net_aliases(spark).collect()}


def test_an_error_leaves_no_tables(spark, design):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with pytest.raises(Exception, match="contain themselves"):
        load_db(design({"m": {"top": cell([block("m", "top", "I")])}}, "m", "top"), spark)
    assert set(os.listdir(folder)) == before


def test_library_names_as_in_addresses(spark, design):
    name = "a b%20#c"
    db = load_db(design({name: {"top": cell(metals=[rect("M1", 0, 0, 0, 5)])}}, name, "top"), spark)
    assert db.instances.count() == 1
    db.close()
