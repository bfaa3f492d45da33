"""The hand-sized designs, end to end from JSON and YAML files."""

from pathlib import Path

import loomtrace
from layouts import DEMO, TOP_FLAT, TOP_METALS, TOP_REPORT
from loomtrace.operators import connect
from loomtrace.operators.hierarchy import task_list, tree_dump


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def net_ext(db):
    out = {}
    for idx, key, net in rows(db.scope, "idx", "key", "net"):
        out.setdefault(idx, {})[key] = net
    return out


def test_top_end_to_end(spark, design, tmp_path):
    result = loomtrace.run_lvs(design({"demo": DEMO}, "demo", "top"), spark)
    flat = result.merged.flat
    metals = flat.metals
    assert set(rows(metals, "layer", "p", "s_start", "s_end", "net", "inst_idx")) == TOP_FLAT
    assert metals.count() == len(TOP_FLAT)
    merged = rows(result.merged.metals.orderBy("idx"), "idx", "layer", "p", "s_start", "s_end", "net")
    assert merged == TOP_METALS
    assert result.merged.count() == 10
    found = rows(result.components.orderBy("comp_id"), "comp_id", "n_metals", "net", "is_consistent")
    assert found == [(1, 4, "A", False), (4, 2, None, True)]
    assert not result.is_consistent()
    members = sorted(rows(result.members, "comp_id", "idx"))
    assert members == [(1, 1), (1, 2), (1, 8), (1, 10), (4, 4), (4, 7)]
    report = tmp_path / "log" / "demo_top.out"
    text = "".join(p.read_text() for p in sorted(report.glob("part-*")))
    assert text == TOP_REPORT
    vias = rows(flat.vias.orderBy("vidx"), "vidx", "type", "x", "y", "ext_x", "ext_y", "inst_idx")
    assert vias == [
        (1, "via_M2_M3_0", 150, 50, 10, 10, 1), (2, "via_M1_M2_0", 300, 0, 10, 10, 1),
        (3, "via_M1_M2_1", 400, 20, 10, 20, 1), (4, "via_M1_M2_0", 20, 50, 10, 10, 2),
        (5, "via_M1_M2_0", 20, 80, 10, 10, 2), (6, "via_M1_M2_0", 220, 50, 10, 10, 3),
        (7, "via_M1_M2_0", 220, 20, 10, 10, 3),
    ]
    orientation = flat.database.config.orientation
    edges = connect.connect_edges(flat.vias, result.merged.metals, orientation)
    assert sorted(rows(edges, "vidx", "u", "v")) == [(1, 8, 10), (3, 4, 7), (4, 1, 8), (6, 2, 8)]
    dangling = connect.dangling_vias(flat.vias, result.merged.metals, orientation)
    assert sorted(rows(dangling, "vidx", "hits")) == [(2, 1), (5, 1), (7, 1)]
    flat.database.close()


def test_closed_start_option(spark, design):
    result = loomtrace.run_lvs(design({"demo": DEMO}, "demo", "top"), spark, closed=True, write=False)
    members = sorted(rows(result.members, "comp_id", "idx"))
    assert (3, 3) in members and (3, 5) in members
    result.merged.flat.database.close()


def test_instances_and_names_of_chip(spark, design):
    db = loomtrace.load_db(design({"demo": DEMO}, "demo", "chip"), spark)
    placed = rows(db.instances.orderBy("idx"), "idx", "parent_idx", "path", "depth", "cell", "inst_name",
                  "m_name", "a", "d", "tx", "ty", "width", "height")
    assert placed == [
        (1, None, [0], 0, "chip", "chip", "chip", 1, 1, 0, 0, 1000, 1000),
        (2, 1, [0, 0], 1, "top", "T0", "chip__T0", -1, 1, 1000, 5, 500, 200),
        (3, 2, [0, 0, 0], 2, "inv", "I0", "chip__T0__I0", -1, 1, 1000, 5, 100, 100),
        (4, 2, [0, 0, 1], 2, "inv", "I1", "chip__T0__I1", -1, -1, 800, 105, 100, 100),
    ]
    names = net_ext(db)
    assert names[2] == {"A": "X", "VDD:": "VDD:", "VSS:": "chip__T0__VSS:"}
    assert names[3] == {"IN": "X", "OUT": "chip__T0__B"}
    assert names[4] == {"IN": "chip__T0__B", "OUT": "chip__T0__UNKNOWN"}
    lines = [line for _, line in sorted(rows(tree_dump(db.instances), "idx", "line"))]
    assert lines == ["chip", "  top", "    inv", "    inv"]
    assert sorted(rows(task_list(db.instances), "cell", "depth")) == [("chip", 0), ("inv", 2), ("top", 1)]
    db.close()


def test_unbound_terminals_can_stay_unknown(spark, design):
    db = loomtrace.load_db(design({"demo": DEMO}, "demo", "chip"), spark, strict_null=True)
    assert net_ext(db)[4] == {"IN": "chip__T0__B", "OUT": "UNKNOWN"}
    db.close()


def test_store_gives_the_same_design(spark, design, tmp_path):
    from loomtrace.plans.pipeline import ingest

    runset = design({"demo": DEMO}, "demo", "top")
    store = str(tmp_path / "store")
    ingest(runset, store, spark)
    result = loomtrace.mergeVector(runset, spark, store=store)
    merged = rows(result.metals.orderBy("idx"), "idx", "layer", "p", "s_start", "s_end", "net")
    assert merged == TOP_METALS
    result.flat.database.close()
