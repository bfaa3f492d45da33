"""Operators against brute force on random and on deliberately skewed input."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.nets import unify
from loomtrace.operators.flatten import place_shapes
from loomtrace.operators import components as comp
from loomtrace.operators import connect, merge
from loomtrace.operators.ordering import number_in_order, running_sum_before
from loomtrace.workspace import Workspace

ODD_VERTICAL = {1: True, 2: False, 3: True}
SHAPE = "layer int, p bigint, s_start bigint, s_end bigint, net string"


@pytest.fixture
def ws(spark):
    space = Workspace(spark)
    yield space
    space.close()


def sweep(shapes):
    """Union of spans per track by painting them in order."""
    tracks = defaultdict(list)
    for layer, p, lo, hi, net in shapes:
        tracks[layer, p].append((lo, hi, net if net != "UNKNOWN" else None))
    out = []
    for (layer, p), spans in tracks.items():
        current = None
        for lo, hi, net in sorted(spans, key=lambda s: s[:2]):
            if current is None or lo > current[1]:
                current = [lo, hi, set()]
                out.append((layer, p, current))
            current[1] = max(current[1], hi)
            if net is not None:
                current[2].add(net)
    return {(layer, p, c[0], c[1], min(c[2], default=None), max(c[2], default=None)) for layer, p, c in out}


def random_shapes(rng, n, span=200, longest=30):
    out = []
    for _ in range(n):
        lo = rng.randint(-span, span)
        net = rng.choice([None, None, "UNKNOWN", "A", "B", "C"])
        out.append((rng.randint(1, 3), rng.randint(-2, 2), lo, lo + rng.choice([0, 1, rng.randint(0, longest)]), net))
    return out


@pytest.mark.parametrize("tile_bits", [2, 4, 20])
def test_merge_equals_sweep_for_any_tile_size(spark, ws, tile_bits):
    shapes = random_shapes(random.Random(tile_bits), 300) + [(1, 0, -190, 150, "A"), (1, 0, -16, -16, "B")]
    df = spark.createDataFrame(shapes, SHAPE)
    got = {tuple(r) for r in merge.merge_intervals(df, ws, tile_bits).collect()}
    assert got == sweep(shapes)


def test_merge_edges(spark, ws):
    shapes = [
        (1, 5, 0, 4, "A"), (1, 5, 4, 8, "A"), (1, 5, 8, 8, None),  # touching, over tile borders
        (1, 5, 9, 9, "B"), (1, 5, 10, 12, None),                    # one apart stays apart
        (1, 6, 0, 10, "A"), (1, 6, 5, 6, "B"), (1, 6, 11, 12, None),  # two names in one run, none in the next
    ]
    df = spark.createDataFrame(shapes, SHAPE)
    got = {tuple(r) for r in merge.merge_intervals(df, ws, 2).collect()}
    assert got == {
        (1, 5, 0, 8, "A", "A"), (1, 5, 9, 9, "B", "B"), (1, 5, 10, 12, None, None),
        (1, 6, 0, 10, "A", "B"), (1, 6, 11, 12, None, None),
    }
    shorts = merge.intra_metal_shorts(merge.merge_intervals(df, ws)).select("p", "s_start").collect()
    assert [tuple(r) for r in shorts] == [(6, 0)]


def test_merge_of_nothing(spark, ws):
    empty = spark.createDataFrame([], SHAPE)
    assert merge.merge_intervals(empty, ws).count() == 0
    assert merge.number_metals(merge.merge_intervals(empty, ws), ws).count() == 0


def test_metals_are_numbered_in_track_order(spark, ws):
    shapes = random_shapes(random.Random(3), 400)
    metals = merge.number_metals(merge.merge_intervals(spark.createDataFrame(shapes, SHAPE), ws), ws)
    rows = [tuple(r) for r in metals.orderBy("idx").select("idx", "layer", "p", "s_start").collect()]
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_all_names_of_a_merged_wire(spark, ws):
    shapes = random_shapes(random.Random(4), 200)
    df = spark.createDataFrame(shapes, SHAPE)
    metals = merge.number_metals(merge.merge_intervals(df, ws), ws)
    where = {r["idx"]: r for r in metals.collect()}
    expected = {(i, s[4]) for s in shapes if s[4] not in (None, "UNKNOWN") for i, m in where.items()
                if (m["layer"], m["p"]) == s[:2] and m["s_start"] <= s[2] <= m["s_end"]}
    assert {tuple(r) for r in merge.merged_nets(df, metals).collect()} == expected


@pytest.mark.parametrize("closed", [False, True])
def test_locate_equals_nested_loops(spark, closed):
    rng = random.Random(7)
    metals, idx = [], 0
    for layer, p in [(1, 0), (1, -3), (2, 4)]:
        at = -400_000
        for length in [0, 1, 63, 64, 65, 4096, 5000, 300_000, 700_000, 10]:
            idx += 1
            metals.append((idx, layer, p, at, at + length))
            at += length + rng.randint(1, 50)
    spots = sorted({v for m in metals for v in (m[3] - 1, m[3], m[3] + 1, m[4] - 1, m[4], m[4] + 1)})
    points = [(n, layer, p, s) for n, (layer, p, s) in
              enumerate((layer, p, s) for layer, p in [(1, 0), (1, -3), (2, 4), (2, 5)] for s in spots)]
    found = connect.locate(
        spark.createDataFrame(points, "vidx bigint, layer int, p bigint, s bigint"),
        spark.createDataFrame(metals, "idx bigint, layer int, p bigint, s_start bigint, s_end bigint"), closed,
    )
    low = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    expected = {(v, i) for v, layer, p, s in points for i, ml, mp, lo, hi in metals
                if (layer, p) == (ml, mp) and low(lo, s) and s <= hi}
    got = [tuple(r) for r in found.select("vidx", "idx").collect()]
    assert set(got) == expected and len(got) == len(expected)


def crossing(spark):
    metals = spark.createDataFrame(
        [(1, 1, 0, 0, 100), (2, 2, 50, -10, 10), (3, 2, 60, -10, -5)],
        "idx bigint, layer int, p bigint, s_start bigint, s_end bigint")
    vias = [(n, "via_M1_M2_0", 1, 2, 0, 50) for n in range(1, 41)]  # one hot site
    vias += [(41, "via_M1_M2_0", 1, 2, 0, 60), (42, "via_M1_M2_1", 1, 2, 7, 7), (43, "via_M1_M1_0", 1, 1, 0, 20),
             (44, "via_M1_M7_0", 1, 7, 0, 20)]
    return spark.createDataFrame(vias, "vidx bigint, type string, lower int, upper int, x bigint, y bigint"), metals


def test_parallel_and_dangling_vias(spark):
    vias, metals = crossing(spark)
    found = {r["vidx"]: (r["hits"], r["u"], r["v"]) for r in
             connect.via_metal_lookup(vias, metals, ODD_VERTICAL).collect()}
    assert found == {**{n: (2, 1, 2) for n in range(1, 41)}, 41: (1, 1, 1), 42: (0, None, None), 43: (2, 1, 1),
                     44: (1, 1, 1)}
    back = connect.metal_via_lookup(metals, vias, ODD_VERTICAL).collect()
    assert Counter(r["idx"] for r in back) == {1: 43 + 0, 2: 40}
    assert connect.site_edges(vias, metals, ODD_VERTICAL).count() == 2


def labels_of(spark, ws, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    rows = comp.connected_components(df, ws).collect()
    out = {r["idx"]: r["comp_id"] for r in rows}
    assert len(out) == len(rows)
    return out


def brute_labels(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in root}


def test_components_of_random_graphs(spark, ws):
    rng = random.Random(11)
    edges = [tuple(rng.sample(range(1, 150), 2)) for _ in range(90)]
    edges += [(200, n) for n in range(201, 240)]      # a hub
    edges += [(500 + n, 300 + n) for n in range(3)]   # reversed pairs
    edges += [(7, 7), (999, 999), (7, 8), (8, 7)]     # loops and parallels
    assert labels_of(spark, ws, edges) == brute_labels(edges)


def test_components_of_a_long_chain(spark, ws):
    order = list(range(1, 401))
    random.Random(5).shuffle(order)
    edges = list(zip(order, order[1:]))
    assert set(labels_of(spark, ws, edges).values()) == {1}


def test_components_of_nothing(spark, ws):
    assert labels_of(spark, ws, []) == {}
    report = comp.component_report(spark.createDataFrame([], "comp_id bigint, idx bigint, net string"))
    assert tuple(comp.overall_consistency(report).first()) == (True, 0, 0)


def test_groups_and_floods(spark):
    metals = spark.createDataFrame([(1, "A"), (2, None), (3, "B"), (4, "A"), (5, None)], "idx bigint, net string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "idx bigint, comp_id bigint")
    groups = {tuple(r) for r in comp.net_groups(labels, metals).collect()}
    assert groups == {(1, 3, 2, "A"), (4, 1, 1, "A"), (5, 1, 0, None)}
    floods = {tuple(r) for r in comp.net_flood_fill(labels, metals).collect()}
    assert floods == {("A", 1, 3), ("B", 1, 3), ("A", 4, 1)}


def test_a_hot_key_is_split(spark, ws):
    """One cell that holds nearly all wires: adaptive execution deals its rows to many tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        wires = ws.save(spark.range(60_000).repartition(12).select(
            F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(F.lit(0)).alias("cell"), F.lit(1).alias("layer"),
            F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("s_start"),
            F.lit(5).cast("bigint").alias("s_end"), F.col("id").cast("string").alias("net")), "wires")
        placed = ws.save(spark.range(7).select(
            F.col("id").alias("cell"), *[F.lit(v).cast("bigint").alias(n) for n, v in
                                         {"a": 1, "b": 0, "c": 0, "d": 1, "tx": 3, "ty": 4}.items()]), "placed")
        out = place_shapes(wires, placed, ["cell"], ODD_VERTICAL)
        assert len(out.collect()) == 60_000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_aliases(spark):
    names = [(f"n{i}",) for i in range(400)] + [(None,), ("other",)]
    aliases = {f"n{i}": f"r{i % 7}" for i in range(300)}
    found = unify(spark.createDataFrame(names, "net string"), "net", aliases)
    assert Counter(r["net"] for r in found.collect()) == Counter(aliases.get(n, n or "UNKNOWN") for n, in names)


def test_running_sums_over_chunks(spark):
    rows = [(g, n, (n * 7) % 5) for g in ("a", "b") for n in range(50)]
    out = running_sum_before(spark.createDataFrame(rows, "g string, ord int, n int"), ["g"], "ord",
                             {"n": "before"}, chunk=7)
    for g, n, _, before in out.select("g", "ord", "n", "before").collect():
        assert before == sum(v for h, m, v in rows if h == g and m < n)


def test_numbering_many_partitions(spark, ws):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    rows = number_in_order(df, ["k"], "n", ws).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 5001))
