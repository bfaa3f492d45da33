"""Hand-sized designs with known results."""

# The scheme of layer, via type and supply net names.
CONFIG = {
    "Layer": {"order": ["M1", "M2", "M3", "M4", "M5"], "orientation": ["|", "-", "|", "-", "|"]},
    "Via": {f"via_M{n}_M{n + 1}_{k}": {"map": [f"M{n}", f"M{n + 1}"], "extension": [10, 10 + 10 * k]}
            for n in range(1, 5) for k in (0, 1)},
    "Equivalent_net_sets": [["VDD:", "VDD", "vdd", "vdd:"], ["VSS:", "VSS", "vss", "vss:", "gnd"]],
}


def rect(layer, x0, y0, x1, y1, ext=0, net=..., vext=None):
    out = {"layer": layer, "xy": [[x0, y0], [x1, y1]], "hextension": ext,
           "vextension": ext if vext is None else vext}
    if net is not ...:
        out["netname"] = net
    return out


def via(kind, x, y):
    lower, upper = kind.split("_")[1:3]
    return {"cellname": kind, "xy": [x, y], "layer": [lower, upper]}


def block(lib, cell, name, transform="R0", xy=(0, 0), pins=None):
    out = {"libname": lib, "cellname": cell, "name": name, "transform": transform, "xy": list(xy)}
    if pins is not None:
        out["pins"] = {f"p{n}": {"termname": t, "netname": net} for n, (t, net) in enumerate(pins)}
    return out


def cell(subblocks=(), primitives=(), metals=(), labels=(), pins=(), vias=(), bbox=((0, 0), (100, 100))):
    return {"bbox": [list(b) for b in bbox], "subblocks": list(subblocks), "primitives": list(primitives),
            "metals": list(metals), "labels": list(labels), "pins": list(pins), "vias": list(vias)}


INV = cell(
    metals=[rect("M1", 20, 10, 20, 40, 5), rect("M2", 10, 50, 60, 50, 5)],
    labels=[rect("M1", 20, 40, 20, 70, 0, "OUT")],
    pins=[rect("M2", 10, 80, 60, 80, 5, "IN")],
    vias=[via("via_M1_M2_0", 20, 50), via("via_M1_M2_0", 20, 80)],
)
TOP = cell(
    bbox=((0, 0), (500, 200)),
    subblocks=[
        block("demo", "inv", "I0", "R0", (0.0, 0.0), [("IN", "A"), ("OUT", "B")]),
        block("demo", "inv", "I1", "MX", (200, 100), [("IN", "B"), ("OUT", None)]),
    ],
    primitives=[{"pins": {"G": rect("M1", 400, 30, 400, 10, 0, vext=5)}}],
    metals=[rect("M2", 60, 50, 130, 50), rect("M2", 205, 50, 130, 50), rect("M2", 395, 20, 405, 20, 5)],
    labels=[rect("Metal1", 300, 0, 300, 50, 0, "vdd"), rect("M2", 290, 0, 310, 0, 0, "gnd")],
    pins=[rect("M1", 300, 50, 300, 90, 0, "VDD"), rect("M3", 150, 0, 150, 60, 0, "A")],
    vias=[via("via_M2_M3_0", 150, 50), via("via_M1_M2_0", 300, 0), via("via_M1_M2_1", 400, 20)],
)
CHIP = cell(
    bbox=((0, 0), (1000, 1000)),
    subblocks=[block("demo", "top", "T0", "MY", (1000, 5), [("A", "X"), ("VDD", "vdd")])],
)
DEMO = {"inv": INV, "top": TOP, "chip": CHIP}

TOP_FLAT = {
    (1, 20, 5, 45, None, 2), (1, 20, 40, 70, "B", 2), (1, 220, 30, 60, "UNKNOWN", 3),
    (1, 220, 55, 95, None, 3), (1, 300, 0, 50, "VDD:", 1), (1, 300, 50, 90, "VDD:", 1),
    (1, 400, 5, 35, None, 1), (2, 0, 290, 310, "VSS:", 1), (2, 20, 205, 265, "B", 3),
    (2, 20, 390, 410, None, 1), (2, 50, 5, 65, None, 2), (2, 50, 60, 130, None, 1),
    (2, 50, 130, 205, None, 1), (2, 50, 205, 265, None, 3), (2, 80, 5, 65, "A", 2), (3, 150, 0, 60, "A", 1),
}
TOP_METALS = [
    (1, 1, 20, 5, 70, "B"), (2, 1, 220, 30, 95, None), (3, 1, 300, 0, 90, "VDD:"), (4, 1, 400, 5, 35, None),
    (5, 2, 0, 290, 310, "VSS:"), (6, 2, 20, 205, 265, "B"), (7, 2, 20, 390, 410, None),
    (8, 2, 50, 5, 265, None), (9, 2, 80, 5, 65, "A"), (10, 3, 150, 0, 60, "A"),
]
# The lines of a report.
TOP_REPORT = """Total unique nodes found in graph: 6

Starting Connectivity and Netname Consistency Check...
Starting BFS for new component from node (idx=1)...
SHORT: Netname inconsistency! Node (idx=1) has netname 'B', but expected 'A' for this component.
Starting BFS for new component from node (idx=4)...

--- Connectivity Check Report ---
Total connected components found: 2

--- Component 1 ---
Representative Net Name: A
Netname Consistency: Failed
Metal Indices (4): [1, 2, 8, 10]

--- Component 2 ---
Representative Net Name: None (all nodes had 'nothing' netname or component is empty)
Netname Consistency: Passed
Metal Indices (2): [4, 7]

---------------------------------
Overall Graph Netname Consistency: false
---------------------------------
"""
