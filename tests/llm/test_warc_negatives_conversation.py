"""Archives, hard negatives and conversation repair against brute force and on awkward input."""

import base64
import gzip
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import conversation, warc
from loomtrace.llm.negatives import SlotBest, hard_negatives, scores, whole_numbers

# ---- Conversation repair


def cheapest(rows, best=None):
    """(cost, audit, lines) by trying every way: rows are (role, text, fault)."""
    ways = {("", 0): [(0, "", ())]}
    found = []

    def go(state, i, cost, audit, lines, inserted):
        if i == len(rows) and state in ("", "a"):
            found.append((cost, audit, lines))
        for role in ("user", "assistant"):
            if role[0] in conversation.NEXT[state] and inserted < 2:
                go(role[0], i, cost + 2, audit + "I", (*lines, f"{role}:"), inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(state, i + 1, cost + 3, audit + "D", lines, 0)
        if fault in ("blank", "duplicate"):
            return
        extra = fault == "truncated"
        if role[:1] and role[:1] in conversation.NEXT[state]:
            go(role[:1], i + 1, cost + extra, audit + "K", (*lines, f"{role}:{text}"), 0)
        for new in ("user", "assistant"):
            if new[0] in conversation.NEXT[state]:
                go(new[0], i + 1, cost + extra + 2, audit + "R", (*lines, f"{new}:{text}"), 0)

    del ways
    go("", 0, 0, "", (), 0)
    return min(found)


def repaired(rows):
    repair, edits = conversation.Repair(), []
    for row in rows:
        edits += repair.row(*row)
    cost, rest = repair.end()
    edits += rest
    return (cost, "".join(e.letter * e.count for e in edits),
            tuple(f"{e.role}:{e.text}" for e in edits if e.letter != "D"))


def test_repair_is_the_cheapest_and_first():
    rng = random.Random(3)
    for n in itertools.chain(range(6), [6] * 30):
        for _ in range(40 if n < 6 else 1):
            rows = [(rng.choice(["user", "assistant", "system", "tool", "", "Ux"]), f"t{i}",
                     rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(n)]
            assert repaired(rows) == cheapest(rows), rows


def test_repair_holds_only_open_edits():
    rng = random.Random(5)
    repair, most = conversation.Repair(), 0
    for i in range(20_000):
        fault = rng.choice(["", "", "truncated", "duplicate"]) if i < 15_000 else "blank"
        repair.row(rng.choice(["user", "assistant", "system"]), "text", fault)
        nodes, held = [repair.root], 0
        while nodes:
            node = nodes.pop()
            held += len(node.edits)
            nodes += node.branches
        most = max(most, held)
    assert most < 60


CONV = "conv_id long, turn long, role string, text string, present string, seen string"


def test_conversations_with_awkward_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, 1, "user", "Same."), (1, 1, "user", "Same."),
        (1, 2, "user", "Same."), (2, 5, "", ""), (2, None, "assistant", " \t"), (3, 9, "system", "x" * 300_000),
        (4, 1, "user", "Q?"), (4, 3, "assistant", "　"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONV).drop("present")
    got = {r["conv_id"]: r for r in conversation.repair_summary(df).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    assert (got[1]["duplicate"], got[1]["audit"], got[1]["cost"], got[1]["gaps"]) == (2, "KDDI", 8, 0)
    assert (got[2]["blank"], got[2]["gaps"], got[2]["audit"]) == (2, 0, "DD")
    assert got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[4]["truncated"], got[4]["gaps"], got[4]["audit"], got[4]["cost"]) == (1, 1, "KK", 1)
    assert got[4]["repaired_sha256"] == hashlib.sha256("user:Q?\nassistant:　".encode()).hexdigest()
    assert got[None]["blank"] == 1 and got[3]["audit"] == "D"
    gone = df.withColumn("present", F.lit(False))
    assert all(r["audit"] == "" and r["cost"] == 0 for r in conversation.repair_summary(gone).collect())
    assert conversation.repair_summary(df.limit(0)).count() == 0
    edits = conversation.repair_edits(df).where("conv_id = 4").orderBy("place").collect()
    assert [(e["edit"], e["role"], e["text"]) for e in edits] == [("K", "user", "Q?"), ("K", "assistant", "　")]


def test_edits_rebuild_the_summary(spark):
    damaged = conversation.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    lines = {}
    for e in conversation.repair_edits(damaged).orderBy("conv_id", "place").collect():
        lines.setdefault(e["conv_id"], [[], []])
        lines[e["conv_id"]][0].append(e["edit"])
        if e["edit"] != "D":
            lines[e["conv_id"]][1].append(f"{e['role']}:{e['text']}")
    for r in conversation.repair_summary(damaged).collect():
        edits, kept = lines.get(r["conv_id"], [[], []])
        assert r["audit"] == "".join(edits)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


# ---- Archives

def gz(data, level=6):
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def stored(data):
    """A member whose content stands in it as it is, so that what looks like a member inside does too."""
    return gz(data, 0)


def record(name, payload, kind="resource"):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode() + payload + b"\r\n\r\n"


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_ranges(spark, size)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_ranges_with_false_members(spark, tmp_path, ranges):
    rng = random.Random(11)
    want, files = {}, 0
    for files in range(3):
        members = []
        for i in range(40):
            name = f"{files}-{i}"
            body = rng.randbytes(rng.choice([0, 30, 700]))
            if i % 4 == 1:  # a gzip file, and a whole archive, inside the payload
                body += gz(b"no record") + gz(record(f"inside-{name}", b"x")) + rng.randbytes(50)
            want[name] = hashlib.sha1(body).hexdigest()
            members.append((stored if i % 4 == 1 else gz)(record(name, body)))
        (tmp_path / f"{files}.warc").write_bytes(b"".join(members))
    (tmp_path / "junk.warc").write_bytes(b"no archive" + warc.MAGIC + b"\x00broken" + gz(b"other") + gz(record("ok", b"1"))
                                         + gz(record("cut", rng.randbytes(500)))[:-20])
    (tmp_path / "empty.warc").write_bytes(b"")
    want["ok"] = hashlib.sha1(b"1").hexdigest()
    for size in (97, 1500, 1 << 20):
        ranges(size)
        got = warc.read_warc(spark, str(tmp_path)).select("record_id", "payload_digest").collect()
        assert sorted(map(tuple, got)) == sorted(want.items()), size


def test_archives_round_trip(spark, tmp_path, ranges):
    big = "é" * 40_000
    pages = [(1, "http://a/ b\r\nX: y", "<p>" + "w" * 2000), (5, None, "<p>" + "w" * 2000), (3, "u3", "<p>" + "w" * 2000),
             (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (11, "ü", big),
             (None, "n", "<p>" + "w" * 2000), (5, "again", "<p>" + "w" * 2000), (None, "a", "v" * 1000), (None, "b", "v" * 1000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    ranges(500)
    got = warc.op12_warc(spark, str(tmp_path)).collect()
    want = []
    for key, _, html in pages:
        body = (html or "").encode()
        same = [k for k, _, h in pages if h == html and k is not None]
        last = max(same) if len(body) >= 1000 and same and max(same) != key else None
        want.append((key, len(body), hashlib.sha1(body).hexdigest(), "response" if last is None else "revisit", last))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    assert all(r["digest_ok"] is not False for r in got)
    assert all("\r" not in r["target_uri"] and " " not in r["target_uri"] for r in got)
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op12_warc(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    rows = [(f"id{i}", "response", "http://a", b"body%d" % i, hashlib.sha1(b"body%d" % i).hexdigest(), None, None)
            for i in range(5)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload binary, "
                                     "payload_digest string, refers_to string, refers_to_uri string")
    warc.write_warc(df.coalesce(1), str(tmp_path / "out"))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "out").glob("part-*")))
    assert content.count(b"WARC/1.1\r\n") == 5 and b"body3" in content
    digest = base64.b32encode(bytes.fromhex(rows[0][4])).decode()
    assert f"WARC-Payload-Digest: sha1:{digest}".encode() in content


# ---- Hard negatives

ROWS = "vec_id long, label long, vector array<double>, slot int, anchor_id long"


def brute(rows, n_positive=5, n_negative=10):
    def inner(a, b):
        return sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))

    out = []
    clean = [(i, lab, [int(256 * x // 1) for x in v]) for i, lab, v in rows]
    for a, label, v in (r for r in clean if r[0] % 10 == 0):
        scored = sorted((-inner(v, w), i, lab) for i, lab, w in clean if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:n_positive]:
            inside = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:n_negative]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "small"])
def test_negatives_equal_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "small":
        rows = [(i, i % 2, [rng.uniform(-1, 1)] * (1 + i % 3)) for i in range(7)]
    else:
        rows = [(i, rng.randrange(3), [rng.choice([0.1, 0.2, 0.9, -0.3]) if kind == "ties" else rng.gauss(0, 1)
                                       for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], ROWS).repartition(5)
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows)


def test_negatives_with_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, None]),
            (4, 2, [0.5, nan]), (5, 2, [inf, 0.5]), (6, None, [0.5, 0.5]), (None, 2, [0.5, 0.5]), (7, 2, None),
            (8, 2, []), (9, 2, [0.5, 0.5, 7.0]), (10, 1, [1e300, -1e300]), (20, 3, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], ROWS)
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 10 == 0).where("anchor_id = 0").collect()))
    near, far = 2 * 256 * 256, 256 * 256
    assert [r for r in got if r[1] == 1] == [(0, 1, i + 1, n, near, far) for i, n in enumerate([2, 2, 9])]
    assert hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(df.where("vec_id = 1"), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    import numpy as np
    import pyarrow as pa

    a, good = whole_numbers(pa.array([[1e7, 1.0], [None, 1.0]], pa.list_(pa.float64())), 256)
    assert good.tolist() == [True, False]
    assert scores(a[:1], a[:1]).tolist() == [[int(1e7 * 256) ** 2 + 256 ** 2]]
    assert scores(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2 ** 63 - 1, -(2 ** 63 - 1)]]
    best = SlotBest(1, 1, 2)
    best.add(np.array([[5], [7], [7]]), np.array([1, 3, 2]), np.zeros((3, 1), dtype=int))
    assert best.id.tolist() == [[2, 3]]
