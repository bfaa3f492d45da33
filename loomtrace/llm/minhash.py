"""Near-duplicates: one-permutation MinHash with optimal densification, bands, star edges.

A text's set of word shingles is hashed once. The hash space is cut into bins, the least hash
of a bin is its value, and an empty bin borrows from a bin that a fixed permutation names
(Shrivastava, ICML 2017). Bands of values are bucket keys. In a bucket each text is paired
with one centre only, so a bucket of n texts gives n - 1 candidates. Candidates are confirmed
on full sets. A bucket whose texts have not all fallen into one component yet gets further
centres while they join many; then its texts in different components are all tested, block by
block, so every link that a bucket holds counts.

Texts with equal sets are one node from the start, so copies never meet each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import drop, located, map_batches, saved, table, text_of
from loomtrace.operators.components import connected_components
from loomtrace.workspace import Workspace

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
CACHE = 200_000
#: About so many members of a bucket, and shingles of theirs, make a block that is tested at once.
OUTSIDERS = 1024
BLOCK = 1 << 20
#: Shared shingles are counted for so many shingles at a time, and compared for so many members.
COLUMNS = 1024
MEMBERS = 128

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """The distinct ``width``-word shingles, as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words
    is one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    hashes = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        value = cache.get(word)
        if value is None:
            value = cache[word] = xxhash.xxh64_intdigest(word)
        hashes[i] = value
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = _mix(out * _M3 + hashes[i:i + n])
    return np.unique(out)


def _borrow_order(bins: int) -> np.ndarray:
    """For each bin, all bins in the order in which it tries to borrow."""
    order = np.random.default_rng(20170806)
    return np.stack([order.permutation(bins) for _ in range(bins)])


def band_keys(shingles: np.ndarray, bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, for a set that is not empty."""
    bins = bands * rows
    place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, first = np.unique(place.astype(np.int64), return_index=True)
    values, filled = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    values[full], filled[full] = shingles[first], True  # sorted, so the first of a bin is its least
    empty = np.flatnonzero(~filled)
    if len(empty):
        donors = order[empty]
        values[empty] = values[donors[np.arange(len(empty)), filled[donors].argmax(axis=1)]]
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in values.reshape(bands, rows).T:
        key = _mix(key * _M3 + column)
    return key


def _node(shingles: np.ndarray) -> bytes:
    """A 128-bit name of the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _digest() -> Column:
    """A hash of the text as it is, by which a text is found again whether or not its row has an id."""
    return F.xxhash64(text_of())


def signatures(docs: DataFrame, width: int, bands: int, rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, node, bands, digest, *carry) per row; node and bands are null for an empty set."""
    order, cache = _borrow_order(bands * rows), {}

    def work(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_shingles": [], "node": [], "bands": [], "digest": cols["digest"]}
        for text in cols["text"]:
            found = shingle_set(text, width, cache)
            out["n_shingles"].append(len(found))
            out["node"].append(_node(found) if len(found) else None)
            out["bands"].append(band_keys(found, bands, rows, order).view(np.int64) if len(found) else None)
        return out | {c: cols[c] for c in carry}

    rows_in = docs.select(
        F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"), _digest().alias("digest"), *carry)
    schema = "doc_id long, n_shingles long, node binary, bands array<long>, digest long" + "".join(
        f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return map_batches(rows_in, work, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes (node, rep, digest: of a row that has it), each once."""
    cache: dict[bytes, int] = {}

    def work(cols: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(text, width, cache) for text in cols["text"]]
        keep = [i for i, s in enumerate(sets) if len(s) and _node(sets[i]) == cols["node"][i]]
        return {"node": [cols["node"][i] for i in keep], "shingles": [sets[i].view(np.int64) for i in keep]}

    texts = docs.select(
        F.col("doc_id").cast("long"), _digest().alias("text_digest"), text_of().cast("binary").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_digest") == F.col("digest"))
    found = texts.join(wanted.select("node", "rep", "digest"), same).select("node", "text")
    # Rows with one id and one text, or one text and no id, give one set each.
    return map_batches(found, work, "node binary, shingles array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v) with 100 * shared shingles >= percent * all their shingles.

    Sets of v travel to u: u is a centre, so the many copies of one u are rows of the side that
    can be split, and each meets its set once per task.
    """
    v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("v_set"))
    u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("u_set"))
    both = pairs.join(v, "v").join(u, "u")
    shared = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - shared
    return both.where(100 * shared >= percent * union).select("u", "v")


def _centres(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"))


def _labels(links: DataFrame) -> DataFrame:
    """(node, comp) of every linked node."""
    ws = Workspace(links.sparkSession)
    try:
        return saved(connected_components(links, ws).select(
            F.col("idx").alias("node"), F.col("comp_id").alias("comp")), "near-labels")
    finally:
        ws.close()


def _rough_labels(links: DataFrame) -> DataFrame:
    """(node, comp): for each node a linked node two steps further down at most.

    Nodes with one label are in one component; those of one component may still differ. That
    is enough to leave pairs untested, at the price of two joins instead of whole components.
    """
    parent = links.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("comp"))
    parent = saved(parent, "near-parents")
    above = parent.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
    rough = saved(parent.join(above, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "near-rough")
    drop(parent)
    return rough


def _with_comp(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _prefix_buckets(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node): buckets in which any two of ``nodes`` that are similar enough meet.

    Sort a set's shingles by how many of the nodes have them, rarest first. Two sets with
    similarity p both hold one of the first (1 - p) * size + 1 of the other's (prefix filtering,
    Chaudhuri et al., ICDE 2006). Shingles of one node alone come first and need no bucket, so
    texts that only share a passage have no bucket at all.
    """
    some = sets.join(nodes, "node").select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    some = saved(some, "near-shingles")
    common = some.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = some.join(common, "key").groupBy("node", "size").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("rare"))  # one text's shingles
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    left = prefix - (F.col("size") - F.size("rare"))  # the places that single shingles do not fill
    return ranked.where(left > 0).select(
        "node", F.explode(F.slice("rare.key", F.lit(1), left.cast("int"))).alias("key")).select("key", "node")


def _open_buckets(members: DataFrame) -> DataFrame:
    """(key, total, main, others): buckets of ``members`` (key, node, comp) with two components or more.

    ``main`` is the component with most members, ``others`` the number of members outside it.
    """
    parts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("key").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("n_comps"),
    ).where("n_comps > 1").select("key", "total", F.col("most.comp").alias("main"),
                                  (F.col("total") - F.col("most.n")).alias("others"))


def _cells(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, node, comp, own, other, cell): ``members`` (key, node, comp, main) dealt to the cells of their buckets.

    The members of a bucket outside its main component fall into ``own`` blocks, all its members
    into ``other`` ones, of about OUTSIDERS members and BLOCK shingles. A cell is one of each, so
    any pair with a member apart meets in a cell, and a cell is of bounded size whatever its bucket's.
    ``own`` is null for members of the main component.
    """
    sized = members.join(sizes, "node").withColumn("apart", F.col("comp") != F.col("main"))
    blocks = lambda n, size: F.greatest(F.ceil(n / OUTSIDERS), F.ceil(size / BLOCK)).cast("int")
    per = sized.groupBy("key").agg(
        blocks(F.sum(F.col("apart").cast("int")), F.sum(F.when(F.col("apart"), F.col("size")))).alias("n_own"),
        blocks(F.count(F.lit(1)), F.sum("size")).alias("n_other"))
    place = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    dealt = sized.join(per.where("n_own > 0"), "key").select(
        "key", "node", "comp", F.when(F.col("apart"), place(1, "n_own")).alias("own"), place(2, "n_other").alias("other"),
        "n_own", "n_other")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meets = F.transform(every("n_own"), lambda i: F.struct(i.alias("own"), F.col("other").alias("other")))
    tested = F.transform(every("n_other"), lambda i: F.struct(F.col("own").alias("own"), i.alias("other")))
    cells = F.when(F.col("own").isNull(), meets).otherwise(F.array_union(meets, tested))
    return dealt.select("key", "node", "comp", "own", "other", F.explode(cells).alias("cell"))


def _cell_links(comps: list[bytes], sets: list[np.ndarray], apart: np.ndarray, others: np.ndarray,
                percent: int) -> list[tuple[int, int]]:
    """Pairs of one cell that are similar enough, as few as join the components that its pairs join.

    ``apart`` and ``others`` are the places of the two blocks' members. Shared shingles are counted
    for all pairs at once, as products of 0-1 matrices over the shingles that both blocks hold.
    """
    sizes = np.array([len(s) for s in sets])
    codes = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([codes[c] for c in comps])
    rows = [np.repeat(np.arange(len(part)), sizes[part]) for part in (apart, others)]
    flat = [np.concatenate([sets[i] for i in part]) for part in (apart, others)]
    both = np.intersect1d(*flat)
    kept = [np.isin(f, both) for f in flat]
    rows = [r[k] for r, k in zip(rows, kept)]
    places = [np.searchsorted(both, f[k]) for f, k in zip(flat, kept)]
    orders = [np.argsort(c, kind="stable") for c in places]
    rows, places = [r[o] for r, o in zip(rows, orders)], [c[o] for c, o in zip(places, orders)]
    shared = np.zeros((len(apart), len(others)), dtype=np.float32)
    for low in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - low)
        halves = []
        for r, c, part in zip(rows, places, (apart, others)):
            start, end = np.searchsorted(c, (low, low + width))
            half = np.zeros((len(part), width), dtype=np.float32)
            half[r[start:end], c[start:end] - low] = 1
            halves.append(half)
        shared += halves[0] @ halves[1].T
    label, links = np.arange(len(codes)), []
    # A few members at a time, as nearly all pairs of a block may be similar.
    for low in range(0, len(apart), MEMBERS):
        part, counts = apart[low:low + MEMBERS], shared[low:low + MEMBERS]
        union = sizes[part][:, None] + sizes[others][None, :] - counts
        for i, similar in zip(part, 100 * counts >= percent * union):
            own, near = label[comp[i]], others[similar]
            found, first = np.unique(label[comp[near]], return_index=True)
            fresh = found != own
            if fresh.any():
                links += [(int(i), int(j)) for j in near[first[fresh]]]
                label[np.isin(label, found)] = own
    return links


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): confirmed links that join all components which links between ``members`` of one bucket join.

    Members of different components of a bucket are all tested on full sets, cell by cell, inside tasks:
    what is shuffled grows with the members and their blocks, not with the pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def linked() -> pa.RecordBatch:
            own, other = at[1:]
            apart = np.array([i for i, r in enumerate(rows) if r[2] == own], dtype=np.int64)
            others = np.array([i for i, r in enumerate(rows) if r[3] == other], dtype=np.int64)
            found = []
            if len(apart) and len(others):
                found = _cell_links([r[1] for r in rows], [r[4] for r in rows], apart, others, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[pair[side]][0] for pair in found], pa.binary()) for side in (0, 1)], names=["u", "v"])

        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("key", "cell_own", "cell_other", "node", "comp", "own", "other")}
            flat = batch.column("shingles")
            for i, place in enumerate(zip(cols["key"], cols["cell_own"], cols["cell_other"])):
                if place != at:
                    if rows:
                        yield linked()
                    at, rows = place, []
                rows.append((cols["node"][i], cols["comp"][i], cols["own"][i], cols["other"][i],
                             flat[i].values.to_numpy(zero_copy_only=False).copy()))
        if rows:
            yield linked()

    cell = ["key", "cell_own", "cell_other"]
    dealt = _cells(members, sets.select("node", F.size("shingles").alias("size"))).select(
        "key", F.col("cell.own").alias("cell_own"), F.col("cell.other").alias("cell_other"), "node", "comp", "own", "other")
    full = dealt.join(sets, "node").repartition(*cell).sortWithinPartitions(*cell)
    return full.mapInArrow(run, "u binary, v binary")


def links_of(docs: DataFrame, nodes: DataFrame, width: int, percent: int, dense: int = 64) -> DataFrame:
    """(node, comp) of all nodes linked with another, from ``nodes`` (node, rep, digest, bands).

    After the first star, buckets with two components or more go on with a further centre each, as long as
    that joins many. Then all members that stand apart meet the others of their bucket, in blocks
    (``_block_links``). Where a row would be sent to more than ``dense`` blocks on average, the members only look
    alike, and the exact buckets of ``_prefix_buckets`` take the place of theirs.
    """
    members = nodes.select("node", F.explode("bands").alias("key"))
    centres = _centres(members).where("n > 1")
    shared = saved(members.join(centres, "key").select("key", "node", "centre", "n"), "near-buckets")
    star = shared.where(F.col("node") != F.col("centre")).select(
        F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    star = saved(star, "near-star")
    ends = star.select(F.col("u").alias("node")).union(star.select(F.col("v").alias("node"))).distinct()
    sets = saved(shingle_sets(docs, nodes.select("node", "rep", "digest").join(ends, "node"), width), "near-sets")
    links = saved(confirmed(star, sets, percent), "near-links")
    drop(star)

    rest = saved(shared.where((F.col("n") > 2) & (F.col("node") != F.col("centre"))).select("key", "node"), "near-rest")
    drop(shared)
    apart_before, exact = None, False
    while True:
        rough = _rough_labels(links)
        members = saved(_with_comp(rest, rough), "near-members")
        drop(rest, rough)
        main = saved(_open_buckets(members), "near-open")
        copies = F.col("total") * F.ceil(F.col("others") / OUTSIDERS) + F.col("others") * F.ceil(F.col("total") / OUTSIDERS)
        work = main.agg(F.sum("total").alias("rows"), F.sum("others").alias("apart"), F.sum(copies).alias("copies")).first()
        if not work["rows"]:
            drop(members, main)
            break
        slow = apart_before is not None and work["apart"] > 0.7 * apart_before
        apart_before = work["apart"]
        found = members.join(main, "key")
        if slow and not exact and work["copies"] > dense * work["rows"]:
            rest = saved(_prefix_buckets(sets, found.select("node").distinct(), percent), "near-prefixes")
            apart_before, exact = None, True
            drop(members, main)
            continue
        if slow:
            more = saved(_block_links(found, sets, percent), "near-block")
            rest = None
        else:
            # Outsiders first, by the order of their names.
            own, order = F.struct("node", "comp"), F.struct(F.col("comp") == F.col("main"), F.xxhash64("node"))
            centres = found.groupBy("key").agg(F.min_by(own, order).alias("c"))
            found = saved(found.join(centres, "key").select("key", "node", "comp", "c"), "near-centred")
            pairs = found.where(F.col("comp") != F.col("c.comp")).select(
                F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()
            more = saved(confirmed(pairs, sets, percent), "near-more")
            rest = saved(found.where(F.col("node") != F.col("c.node")).select("key", "node"), "near-rest")
            drop(found)
        drop(members, main)
        before, links = links, saved(links.unionByName(more).distinct(), "near-links")
        drop(before, more)
        if rest is None:
            break
    labels = _labels(links)
    drop(links, sets)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, chosen, *carry) for every row of ``docs`` (doc_id, text).

    Two texts are linked if the Jaccard similarity of their ``width``-word shingle sets is at
    least ``percent`` hundredths. component_id is the least doc_id of the texts that links
    reach, and rows that have it are kept. Of several with it the least by ``carry``, the rows'
    places, is ``chosen`` (without places, equal rows all are). With 40 bands of 6 rows a pair at 0.8 is missed with
    probability 5e-6, at 0.9 with 3e-14.

    Texts without words (null ones too) have no set and stay alone. Equal texts always share
    a component. A row without doc_id is linked like any other; where no row of its component has
    an id they all are kept, and the least by ``carry`` is chosen. Other columns are ignored; an empty table gives no row.
    """
    found = saved(signatures(docs, width, bands, rows, carry), "near-signatures")
    # Of a node's rows one stands for all: the least id, rows without one last, then the least place.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *carry, "digest")
    nodes = saved(found.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(first).alias("first"), F.first("bands").alias("bands"),
    ).select("node", "first", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("digest"), "bands"),
        "near-nodes")
    labels = links_of(docs, nodes, width, percent)
    names = nodes.select("node", "first").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = names.groupBy("comp").agg(F.min(F.struct("first", "node")).alias("least"))
    names = names.join(least, "comp").select(
        "node", F.col("least.first.doc_id").alias("component_id"), F.col("least.first").alias("keep"),
        (F.col("node") == F.col("least.node")).alias("has_kept"))
    out = found.select("doc_id", "n_shingles", "node", first.alias("own"), *carry).join(names, "node", "left")
    chosen = F.col("node").isNull() | (F.col("has_kept") & F.col("own").eqNullSafe(F.col("keep")))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), *carry,
        F.col("doc_id").eqNullSafe(component).alias("kept"), chosen.alias("chosen"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = located(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_duplicates(docs, width=4, carry=("_file", "_row")).drop("_file", "_row", "chosen")
