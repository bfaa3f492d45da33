"""Wires of cell libraries: one pass over the parsed cells, whatever their lists hold."""

import json

from loomtrace.sources import library
from loomtrace.sources.config import TechConfig

CONFIG = TechConfig({1: True, 2: False}, {}, {"VCC": "VDD"})


def shape(layer, start, **more):
    return {"layer": layer, "xy": [[10, start], [10, start + 5]], "hextension": 1, "vextension": 2, **more}


def test_wires_in_one_pass(spark):
    """All kinds come from one parse, and names are not dealt out by their few values."""
    lines = [
        {"primitives": [{"pins": {"D": shape("M1", 0), "S": shape("M1", 20)}}, {}, {"pins": {}}],
         "metals": [shape("M1", 40, netname="unused")], "labels": [shape("M1", 60, netname="VCC"), shape("M1", 80)]},
        {"pins": [shape("M1", 100, netname="Q")], "metals": []},
        {},
    ]
    frame = spark.createDataFrame([(json.dumps({"lib": "l", "cell": "c", "content": c}),) for c in lines], "value string")
    found = library.wires(library.parse_cell_lines(frame), CONFIG)
    want = [("primitive", 0, None), ("primitive", 20, None), ("metal", 40, None), ("label", 60, "VDD"),
            ("label", 80, "UNKNOWN"), ("pin", 100, "Q")]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[5]) == [
        ("l", "c", kind, 1, 10, s - 2, s + 7, net) for kind, s, net in want]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json") == 1
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
