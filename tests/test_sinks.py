"""Files written by the sinks."""

import json

import pytest

from loomtrace.operators import components as comp
from loomtrace.sinks import drawing, report, via_json
from loomtrace.workspace import Workspace

ODD_VERTICAL = {1: True, 2: False, 3: True, 4: False, 5: True}


@pytest.fixture
def ws(spark):
    space = Workspace(spark)
    yield space
    space.close()


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_empty_report(spark, ws, tmp_path):
    members = spark.createDataFrame([], "comp_id bigint, idx bigint, net string")
    report.write_connectivity_report(members, str(tmp_path / "r.out"), ws)
    text = text_of(tmp_path / "r.out")
    assert text.startswith("Total unique nodes found in graph: 0\n\nStarting Connectivity")
    assert "Total connected components found: 0\n" in text
    assert text.endswith("Overall Graph Netname Consistency: true\n---------------------------------\n")


def test_lists_are_written_in_blocks(spark, ws):
    rows = [(1, n, "A") for n in range(1, 26)] + [(30, n, None) for n in (30, 99)]
    members = spark.createDataFrame(rows, "comp_id bigint, idx bigint, net string")
    lines = report.connectivity_lines(members, ws, block=10).orderBy("section", "number", "part").collect()
    lists = [r["line"] for r in lines if r["section"] == 3 and r["part"] >= 0]
    assert lists[0].startswith("Metal Indices (25): [1, 2, 3")
    assert lists[3:] == ["Metal Indices (2): [30,", "99]"]
    joined = " ".join(lists[:3])
    assert joined == "Metal Indices (25): [" + ", ".join(str(n) for n in range(1, 26)) + "]"


def test_report_overwrites(spark, ws, tmp_path):
    path = tmp_path / "r.out"
    for n in (3, 1):
        members = spark.createDataFrame([(k, k, None) for k in range(1, n + 1)], "comp_id bigint, idx bigint, net string")
        report.write_connectivity_report(members, str(path), ws)
    assert "Total connected components found: 1\n" in text_of(path)


def test_net_log(spark, tmp_path):
    metals = spark.createDataFrame([(1, 1, 0, 0, 5, "A"), (2, 2, 3, 0, 5, None), (3, 1, 9, 0, 5, None)],
                                   "idx bigint, layer int, p bigint, s_start bigint, s_end bigint, net string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "idx bigint, comp_id bigint")
    flooded = comp.net_flood_fill(labels, metals).select("net", "comp_id")
    lines = report.net_log_lines(flooded, comp.all_labels(labels, metals), metals)
    report.write_net_log(lines, str(tmp_path / "log"))
    assert text_of(tmp_path / "log").splitlines() == [
        "Netname: A", "Connected groups: ", "Group 1", "", "Group 1", "Connected MVectors: ",
        "MVector(layer=1, p_coord=0, s=0:5, netname=A)", "MVector(layer=2, p_coord=3, s=0:5, netname=nothing)",
        "", "Unconnected MVectors:",
        "MVector MVector(layer=2, p_coord=3, s=0:5, netname=nothing) has no netname",
        "MVector MVector(layer=1, p_coord=9, s=0:5, netname=nothing) has no netname",
    ]


VIAS = [(1, "via_M1_M2_0", 1, 2, 5, -7, 10, 10), (2, "via_M2_M3_1", 2, 3, 0, 0, 10, 20)]
VIA = "vidx bigint, type string, lower int, upper int, x bigint, y bigint, ext_x int, ext_y int"


def test_via_json_round_trip(spark, tmp_path):
    vias = spark.createDataFrame(VIAS, VIA)
    via_json.write_via_json(vias, str(tmp_path / "vias"))
    back = via_json.read_via_json(spark, str(tmp_path / "vias")).collect()
    assert sorted((r["type"], r["xy"], r["extension"], r["layer"]) for r in back) == [
        ("via_M1_M2_0", [5, -7], [10, 10], ["M1", "M2"]), ("via_M2_M3_1", [0, 0], [10, 20], ["M2", "M3"])]


def test_grouped_via_json(spark, tmp_path):
    point = {"xy": [1, 2], "extension": [10, 10], "layer": ["M1", "M2"], "type": "via_M1_M2_0"}
    path = tmp_path / "vias.json"
    path.write_text(json.dumps({"via_M1_M2_0": {"type": "via_M1_M2_0", "vpoints": [point, point]}}, indent=2))
    rows = via_json.read_grouped_via_json(spark, str(path)).collect()
    assert [r.asDict() for r in rows] == [point, point]


def test_drawing(spark, tmp_path):
    wires = spark.createDataFrame([(1, 3, 0, 9), (2, 4, -1, 8)], "layer int, p bigint, s_start bigint, s_end bigint")
    segments = drawing.wire_segments(wires, ODD_VERTICAL, {1: "teal"})
    assert [tuple(r) for r in segments.orderBy("layer").collect()] == [
        (1, 3, 0, 3, 9, "teal"), (2, -1, 4, 8, 4, "black")]
    drawing.write_segments_by_layer(segments, str(tmp_path / "seg"))
    assert sorted(p.name for p in (tmp_path / "seg").glob("layer=*")) == ["layer=1", "layer=2"]
    boxes = drawing.via_outlines(spark.createDataFrame(VIAS, VIA), {"via_M1_M2_0": "gold"}, 0.5).orderBy("vidx").collect()
    assert tuple(boxes[0]) == (1, "via_M1_M2_0", 0.0, -12.0, 10.0, -2.0, "gold")
