"""Paths of shorts, opens, sweeps and as-of joins against brute force on random wires."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import opens, sweep, trace
from loomtrace.workspace import Workspace, row_count

ORIENTATION = {1: True, 2: False, 3: True}
EDGES = "vidx long, u long, v long"
MEMBERS = "comp_id long, idx long, net string"
METALS = "idx long, layer int, p long, s_start long, s_end long"


@pytest.fixture
def ws(spark):
    space = Workspace(spark)
    yield space
    space.close()


def components(n, edges):
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for _, u, v in edges:
            least = min(comp[u], comp[v])
            changed |= comp[u] != least or comp[v] != least
            comp[u] = comp[v] = least
    return comp


def shortest(edges, comp, nets):
    """All rows of ``short_paths`` by a search from each end."""
    near = defaultdict(dict)
    for via, u, v in edges:
        if u != v:
            near[u][v] = near[v][u] = min(via, near[u].get(v, via))
    out = []
    for c in set(comp):
        names = {nets[i] for i in range(len(comp)) if comp[i] == c and nets[i]}
        if len(names) < 2:
            continue
        expected = min(names)
        dist = {i: 0 for i in range(len(comp)) if comp[i] == c and nets[i] == expected}
        queue = deque(dist)
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if j not in dist:
                    dist[j] = dist[i] + 1
                    queue.append(j)
        for net in names - {expected}:
            _, i = min((dist[i], i) for i in dist if nets[i] == net)
            step = 0
            while True:
                following = min((j for j in near[i] if dist[j] == dist[i] - 1), default=None)
                out.append((c, expected, net, step, i, near[i].get(following)))
                if following is None:
                    break
                i, step = following, step + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_paths(spark, ws, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(k, *sorted((rng.randrange(n), rng.randrange(n)))) for k in range(45)]
    edges += [(100 + k, k, k + 1) for k in range(20)]  # a long chain
    comp = components(n, edges)
    nets = [rng.choice(["A", "B", "C", None, None, None, None]) for _ in range(n)]
    members = spark.createDataFrame([(comp[i], i, nets[i]) for i in range(n)], MEMBERS)
    got = trace.short_paths(spark.createDataFrame(edges, EDGES), members, ws).collect()
    want = shortest(edges, comp, nets)
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 3
    assert trace.short_paths(spark.createDataFrame(edges, EDGES), members.where("net = 'A'"), ws).count() == 0
    assert trace.short_paths(spark.createDataFrame([], EDGES), members.limit(0), ws).count() == 0


def random_metals(rng, n, span):
    """Wires that do not touch on their tracks."""
    out, used = [], defaultdict(list)
    while len(out) < n:
        layer, p, s = rng.randint(1, 3), rng.randrange(-span, span), rng.randrange(-span, span)
        e = s + rng.choice([0, 3, 40, span // 2])
        if all(e < a or b < s for a, b in used[layer, p]):
            used[layer, p].append((s, e))
            out.append((len(out), layer, p, s, e))
    return out


@pytest.mark.parametrize("seed, span, n", [(1, 40, 40), (2, 5000, 40), (3, 100_000, 12)])
def test_net_opens(spark, ws, seed, span, n):
    rng = random.Random(seed)
    metals = random_metals(rng, n, span)
    comp = [rng.randrange(n // 2) for _ in metals]
    comp = [comp.index(c) for c in comp]  # the least member names a group
    nets = [rng.choice(["A", "B", "C", None]) for _ in metals]
    box = [(p, s, p, e) if ORIENTATION[layer] else (s, p, e, p) for _, layer, p, s, e in metals]
    want = []
    for net in "ABC":
        parts = {comp[i] for i in range(n) if nets[i] == net}
        best = [(sum(max(0, max(box[i][a], box[j][a]) - min(box[i][a + 2], box[j][a + 2])) for a in (0, 1)), i, j)
                for i, j in itertools.combinations(range(n), 2) if {comp[i], comp[j]} <= parts and comp[i] != comp[j]]
        want += [(net, len(parts), *min(best))] if best else []
    members = spark.createDataFrame(list(zip(comp, range(n), nets, strict=True)), MEMBERS)
    frame = spark.createDataFrame(metals, METALS)
    assert sorted(map(tuple, opens.net_opens(members, frame, ORIENTATION, ws).collect())) == sorted(want)
    assert opens.net_opens(members.limit(0), frame, ORIENTATION, ws).count() == 0


class Counted(Workspace):
    """Keeps the names and row counts of saved tables; many tables mean rounds without an end."""

    def save(self, df, name):
        self.saved = getattr(self, "saved", [])
        assert len(self.saved) < 60
        table = super().save(df, name)
        self.saved.append((name, row_count(table)))
        return table


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_net_opens_ends_on_a_grid(spark, seed):
    """Many ends on one point; wires that are groups of their own are given apart."""
    rng = random.Random(seed)
    metals, n = [], 40
    for layer, p in {(rng.randint(1, 3), 10 * rng.randrange(-4, 4)) for _ in range(40)}:
        metals += [(layer, p, s, s + 10 * rng.randrange(2)) for s in rng.sample(range(-40, 40, 20), 3)]
    metals = [(i, *m) for i, m in enumerate(sorted(metals)[:n])]
    comp = list(range(n))
    for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(12)):
        comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    nets = [rng.choice(["A", "B", None]) for _ in metals]
    box = [(p, s, p, e) if ORIENTATION[layer] else (s, p, e, p) for _, layer, p, s, e in metals]
    want = []
    for net in "AB":
        parts = {comp[i] for i in range(n) if nets[i] == net}
        best = [(sum(max(0, max(box[i][a], box[j][a]) - min(box[i][a + 2], box[j][a + 2])) for a in (0, 1)), i, j)
                for i, j in itertools.combinations(range(n), 2) if {comp[i], comp[j]} <= parts and comp[i] != comp[j]]
        want.append((net, len(parts), *min(best)))
    members = spark.createDataFrame(list(zip(comp, range(n), nets, strict=True)), MEMBERS)
    frame = spark.createDataFrame(metals, METALS)
    linked = F.col("comp_id").isin([c for c in comp if comp.count(c) > 1])
    lone = frame.join(members.where(~linked).select("idx", "net"), "idx")
    got = [opens.net_opens(members, frame, ORIENTATION, Counted(spark)),
           opens.net_opens(members.where(linked), frame, ORIENTATION, Counted(spark), lone)]
    assert [sorted(map(tuple, rows.collect())) for rows in got] == [want, want]


def test_net_opens_on_either_side_of_the_origin(spark):
    """Squares counted from 0 never hold both wires, however large they are."""
    metals = [(0, 1, -7, -9, -5), (1, 1, 6, 4, 8)]
    members = spark.createDataFrame([(0, 0, "A"), (1, 1, "A")], MEMBERS)
    got = opens.net_opens(members, spark.createDataFrame(metals, METALS), ORIENTATION, Counted(spark))
    assert list(map(tuple, got.collect())) == [("A", 2, 13 + 9, 0, 1)]


def test_net_opens_meets_few_wires(spark):
    """Once two crossing wires are known, those after them look for no others."""
    n = 300
    metals = [(i, 1, 10_000 * i, 0, 50) for i in range(n)] + [(n + i, 2, 0, 10_000 * i, 10_000 * i + 50) for i in range(n)]
    members = spark.createDataFrame([(i, i, "A") for i in range(2 * n)], MEMBERS)
    ws = Counted(spark)
    got = opens.net_opens(members, spark.createDataFrame(metals, METALS), ORIENTATION, ws)
    assert list(map(tuple, got.collect())) == [("A", 2 * n, 0, 0, n)]
    assert sum(rows for name, rows in ws.saved if name in ("squares", "wide", "near")) < 20


@pytest.mark.parametrize("bits", [3, 16])
def test_sweeps(spark, ws, bits, monkeypatch):
    """Tiles far smaller than the wires give the same rows as one tile."""
    monkeypatch.setattr(sweep, "TILE_BITS", bits)
    rng = random.Random(bits)
    shapes = [(1, rng.choice([0, 7]), s, s + rng.choice([0, 2, 30]), rng.choice(["A", "B", None, "UNKNOWN"]))
              for s in (rng.randrange(-60, 60) for _ in range(60))]
    frame = spark.createDataFrame(shapes, "layer int, p long, s_start long, s_end long, net string")
    depths = sweep.track_depth(frame, ws)
    want = []
    for p in (0, 7):
        rows = [r for r in shapes if r[1] == p and r[2] < r[3]]
        places = sorted({x for r in rows for x in r[2:4]})
        for a, b in itertools.pairwise(places):
            here = [r for r in rows if r[2] <= a and r[3] >= b]
            if here:
                want.append((1, p, a, b, len(here), len({r[4] for r in here} - {None, "UNKNOWN"})))
    assert sorted(map(tuple, depths.collect())) == sorted(want)
    spans = sorted(map(tuple, sweep.conflict_spans(depths, ws).collect()))
    covered = {(p, x) for _, p, a, b, most in spans for x in range(a, b) if most == 2}
    assert covered == {(r[1], x) for r in want if r[5] > 1 for x in range(r[2], r[3])}
    assert all(not (x[1] == y[1] and x[3] == y[2]) for x in spans for y in spans)
    assert sweep.track_depth(frame.limit(0), ws).count() == 0


@pytest.mark.parametrize("bits", [2, 16])
@pytest.mark.parametrize("inclusive", [False, True])
def test_last_before(spark, bits, inclusive):
    rng = random.Random(bits)
    points = [(i, rng.choice("xy"), rng.randrange(-40, 40)) for i in range(60)] + [(99, "z", 0)]
    marks = [(rng.choice("xy"), rng.randrange(-40, 40), i) for i in range(12)]
    got = sweep.last_before(spark.createDataFrame(points, "id long, k string, at long"),
                            spark.createDataFrame(marks, "k string, at long, value long"),
                            ["k"], "at", "value", "found", inclusive, bits)
    want = []
    for i, k, at in points:
        before = [(a, v) for g, a, v in marks if g == k and (a < at or inclusive and a == at)]
        want.append((i, k, at, max(before)[1] if before else None))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dangling_nearest(spark):
    metals = spark.createDataFrame([(1, 1, 0, 0, 10), (2, 1, 0, 20, 30), (3, 2, 5, 0, 3), (4, 1, 4, 6, 6)], METALS)
    vias = spark.createDataFrame([(1, 1, 2, 0, 15), (2, 1, 2, 0, 20), (3, 1, 2, 0, 5), (4, 1, 2, 4, 6), (5, 1, 9, 0, 40)],
                                 "vidx long, lower int, upper int, x long, y long")
    got = sorted(map(tuple, sweep.dangling_nearest(vias, metals, ORIENTATION).collect()), key=repr)
    assert got == sorted([
        (1, 1, 1, 5, 2, 5), (1, 2, None, None, None, None), (2, 1, 1, 10, 2, 0), (2, 2, None, None, None, None),
        (3, 2, None, None, 3, 0), (4, 1, None, None, 4, 0), (4, 2, None, None, None, None), (5, 1, 2, 10, None, None),
    ], key=repr)


def test_depth_is_one_pass_over_the_wire_ends(spark, ws):
    """Only the islands of named wires are written out; the ends are sorted once, in tiles."""
    shapes = spark.createDataFrame([(1, 10, 0, 30, "A"), (1, 10, 20, 200000, None)],
                                   "layer int, p long, s_start long, s_end long, net string")
    rows = sweep.track_depth(shapes, ws).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 10, 0, 20, 1, 1), (1, 10, 20, 30, 2, 1), (1, 10, 30, 200000, 1, 0)]
    assert ws._count == 1


@pytest.mark.parametrize("bits", [3, 16])
def test_dangling_nearest_reads_its_tables_twice(spark, bits, monkeypatch):
    """Random vias against every wire of their track; both tables are read for the rows and for the tiles only."""
    monkeypatch.setattr(sweep, "TILE_BITS", bits)
    rng = random.Random(bits)
    metals = [(i, 1, i % 2, s, s + rng.choice([0, 1, 3, 25])) for i, s in enumerate(range(-60, 60, 4))]  # some overlap
    vias = [(i, 1, 9, rng.randrange(3), rng.randrange(-80, 100)) for i in range(80)]
    want = []
    for i, layer, _, p, s in vias:
        wires = [m for m in metals if m[2] == p]
        if not any(a < s <= b for *_, a, b in wires):
            left = max([(b, n) for n, _, _, a, b in wires if b < s], default=None)
            right = min([(a, n) for n, _, _, a, b in wires if a >= s], default=None)
            want.append((i, layer, left and left[1], left and s - left[0], right and right[1], right and right[0] - s))
    got = sweep.dangling_nearest(spark.createDataFrame(vias, "vidx long, lower int, upper int, x long, y long"),
                                 spark.createDataFrame(metals, METALS), ORIENTATION)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 4
