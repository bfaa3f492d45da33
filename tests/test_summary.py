"""The check from summaries of cells against the check of the flattened design."""

import random

import pytest

import loomtrace
from layouts import block, cell, rect, via
from loomtrace.operators import summary
from loomtrace.workspace import Workspace

NAMES = ["A", "B", "C", "D", "vdd", None]


def content(rng, size, n_wires, n_vias):
    """Wires and vias on few tracks, so that they meet within a cell and across cells."""
    wires, labels = [], []
    for _ in range(n_wires):
        layer, p, s = rng.randint(1, 3), rng.randrange(0, size, 2), rng.randrange(0, size)
        e = s + rng.randint(0, 6)
        ends = (p, s, p, e) if layer % 2 else (s, p, e, p)
        if rng.random() < 0.4:
            labels.append(rect(f"M{layer}", *ends, 0, rng.choice(NAMES)))
        else:
            wires.append(rect(f"M{layer}", *ends))
    vias = [via(f"via_M{n}_M{n + 1}_0", rng.randrange(0, size, 2), rng.randrange(0, size, 2))
            for n in (rng.randint(1, 2) for _ in range(n_vias))]
    return {"metals": wires, "labels": labels, "vias": vias}


def random_design(rng, reach):
    turns = ["R0", "R180", "MX", "MY"]
    cells = {f"leaf{i}": cell(**content(rng, 14, 30, 30)) for i in range(3)}

    def blocks(names, n):
        return [block("lib", rng.choice(names), f"i{k}", rng.choice(turns),
                      (rng.randint(-reach, reach), rng.randint(-reach, reach)), [("A", rng.choice(["A", "B", "E"]))])
                for k in range(n)]

    for i in range(2):
        cells[f"mid{i}"] = cell(blocks(["leaf0", "leaf1", "leaf2"], 4), **content(rng, 20, 12, 12))
    cells["top"] = cell(blocks(["mid0", "mid1", "leaf0"], 5), **content(rng, 40, 25, 20))
    return cells


@pytest.mark.parametrize("seed, reach", [(1, 12), (2, 30), (4, 90)])
def test_same_components_as_the_flat_check(spark, design, seed, reach):
    runset = design({"lib": random_design(random.Random(seed), reach)}, "lib", "top")
    flat = loomtrace.run_lvs(runset, spark, write=False)
    metals = flat.merged.metals
    want = flat.components.join(metals.select("idx", "layer", "p", "s_start"), metals["idx"] == flat.components["comp_id"])
    want = sorted(map(repr, want.select("layer", "p", "s_start", "n_metals", "net", "is_consistent").collect()))
    db, ws = flat.merged.flat.database, Workspace(spark)
    got = summary.hierarchical_report(db.layout, db.placed, db.config.orientation, ws)
    assert sorted(map(repr, got.collect())) == want and len(want) > 5
    ws.close()
    db.close()


def test_only_boxes_that_touch_are_exported(spark, design):
    rng = random.Random(9)
    leaf = cell(**content(rng, 14, 12, 8))
    row = [block("lib", "leaf", f"i{k}", "R0", (k * 1000, 0)) for k in range(12)]
    pair = [block("lib", "leaf", "j0", "R0", (0, 5000)), block("lib", "leaf", "j1", "R0", (3, 5000))]
    runset = design({"lib": {"leaf": leaf, "top": cell(row + pair)}}, "lib", "top")
    db, ws = loomtrace.load_db(runset, spark), Workspace(spark)
    inst = db.instances.selectExpr("idx AS inst", "lib", "cell", "a", "b", "c", "d", "tx", "ty")
    parts = summary.summarize(db.layout, inst, db.config.orientation, ws)
    exported = summary._export(parts, inst.join(parts.cells, summary.TURNED), db.config.orientation, ws)
    assert {r["inst"] for r in exported.select("inst").distinct().collect()} == {14, 15}
    assert parts.wires.select("cid").distinct().count() == 1
    ws.close()
    db.close()


def test_an_empty_design(spark, design):
    db, ws = loomtrace.load_db(design({"lib": {"top": cell()}}, "lib", "top"), spark), Workspace(spark)
    assert summary.hierarchical_report(db.layout, db.placed, db.config.orientation, ws).count() == 0
    ws.close()
    db.close()
