"""Exact Jaccard self-join of word-shingle sets, with the classes of documents it links.

Two sets of sizes m and n are at Jaccard distance 1/4 or less just if their symmetric difference
is at most (m + n) / 7. That difference is a metric too, and the one in which regions are cut.

Documents at Jaccard distance 1 from every document pivot can't be told apart by such pivots, so
the first pivots are singletons: the cell of a shingle's singleton holds the sets that contain
it. A set belongs to the cell of its rarest shingle, and is replicated to the next
n - ceil(0.75 n) cells, a window that holds a common cell for every two linked sets. Cells with
the same members are one, and cells with the same central document, the one in most
cells, are united to its region.

A region of more than ``LEAF`` documents is joined recursively: document pivots make Voronoi
regions, and a document is replicated to each region whose pivot is, by the triangle inequality,
near enough for a linked one to belong there. Where such regions don't shrink, as all documents
lie within the window, the region is cut by distance from its pivot into rings as wide as a link
is long, so that only the same and neighbouring rings meet, in tiles of bounded size; links with
the pivots are measured first, and members of the class that holds most of the region never meet one another.

Distances between members are bounded below by parity bitmaps: bit h mod B of a set's bitmap is the parity of
its shingles there, and two bitmaps differ in no more bits than the sets in shingles. This distance
obeys the triangle inequality, and never exceeds the true one, so windows on it lose nothing. In
each leaf the pairs that may link are found by it; a spanning forest of them is
measured exactly, then all pairs that still cross classes. Nothing is capped.

Sets are held as 64-bit shingle hashes; rarity is estimated by one row of counters over the whole
corpus, and only orders cells (any order gives the same links). Equal sets are joined beforehand.

Edge cases: null texts and texts without words have no shingles and link with nothing; a text of
fewer than five words is one shingle; rows that repeat an id are each given a row; rows without
an id are given one too, with their class's component; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, saved
from .textarrays import arrow_map, mix, shingle_sets, text_slices

PERCENT = 75
#: Counters of shingle frequency, a byte each (a twelfth of an octave): 16 MB that every task gets.
SKETCH_BITS = 24
STEPS = 12
#: What one task counts at most, before tasks are added up.
_TASK_MOST = 5_000
_BLOCK = 1 << 18
#: Tasks whose counters are added up in one call.
_FAN_IN = 64
#: Documents that are joined at once.
LEAF = 512
#: Document pivots of a region that is cut.
PIVOTS = 4
#: A region is cut by its pivots if its largest part holds at most this share of it, and all parts twice as much.
SHRINKS = 0.8
#: Levels of document pivots at most, before regions are cut into rings alone.
ROUNDS = 20
#: Sets that a task remembers to have dealt to cells; copies beyond are dealt again, and found equal later.
SEEN = 100_000
#: Ids that are broadcast to pick texts or sets; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Bits of the smallest bitmap.
LEAST_BITS = 512


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _fingerprints(x: np.ndarray) -> tuple[int, int]:
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(mix(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).view(np.int64))


def summaries(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One pass: of each document (id, n, f1, f2), and from each task its counters (block, salt, counts)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total, mask = np.zeros(1 << bits, np.uint16), np.uint64((1 << bits) - 1)
        for b in text_slices(batches):
            n, f1, f2 = [], [], []
            sets = list(shingle_sets(b.column(1)))
            for x in sets:
                a, c = _fingerprints(x)
                n.append(len(x))
                f1.append(a)
                f2.append(c)
            for a in range(0, len(sets), 60_000):
                np.add.at(total, (np.concatenate(sets[a : a + 60_000]) & mask).astype(np.int64), 1)
                np.minimum(total, _TASK_MOST, out=total)  # 16 bits hold what 60,000 texts add
            none = pa.nulls(len(n), pa.int32())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), none, none, pa.nulls(len(n), pa.binary())], schema=schema)
        salt = TaskContext.get().partitionId() // _FAN_IN
        for k in range(0, len(total), _BLOCK):
            part = total[k : k + _BLOCK]
            if part.any():
                raw = pa.compress(part.astype(np.uint32).tobytes(), "zstd", asbytes=True)
                yield pa.record_batch([pa.nulls(1, pa.int64())] * 4 + [pa.array([k // _BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([raw], pa.binary())], schema=schema)

    return arrow_map(docs, run, "id long, n long, f1 long, f2 long, block int, salt int, counts binary")


def counters(made: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The counters of all tasks, added up as a tree, as levels; what comes to the driver is 2 ** bits bytes."""

    def adder(last: bool):
        def add(rows: pa.Table) -> pa.Table:
            total = np.zeros(_BLOCK, np.uint64)
            for raw in rows.column("counts").to_pylist():
                total += np.frombuffer(pa.decompress(raw, 4 * _BLOCK, "zstd", asbytes=True), np.uint32)
            # Logarithms keep common shingles apart from others however large the corpus is.
            told = np.minimum(STEPS * np.log2(1.0 + total), 255).astype(np.uint8) if last else np.minimum(total, (1 << 32) - 1).astype(np.uint32)
            return rows.slice(0, 1).select(["block", "salt"]).append_column("counts", pa.array([pa.compress(told.tobytes(), "zstd", asbytes=True)], pa.binary()))

        return add

    rows = made.where("block is not null").select("block", "salt", "counts")
    for fan_in in (1, _FAN_IN, _FAN_IN**2):
        rows = rows.withColumn("salt", F.expr(f"cast(salt div {fan_in} as int)")).groupBy("block", "salt").applyInArrow(adder(fan_in == _FAN_IN**2), "block int, salt int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for block, _, raw in rows.collect():
        part = np.frombuffer(pa.decompress(bytes(raw), _BLOCK, "zstd", asbytes=True), np.uint8)
        at = slice(block * _BLOCK, (block + 1) * _BLOCK)
        out[at] = np.maximum(out[at], part)
    return out


def cells(docs: DataFrame, rarity: Broadcast, percent: int = PERCENT) -> DataFrame:
    """Rows (cell, id, n): each set in the cells of its rarest shingles, as many as links may need."""

    def run(batches):
        order_by, seen = rarity.value, set()
        mask = np.uint64(len(order_by) - 1)
        for b in text_slices(batches):
            got, ids, ns = [], [], []
            for i, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                n = len(x)
                key = (n, *_fingerprints(x)) if n else None
                if i is None or not n or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                often = order_by[(x & mask).astype(np.int64)].astype(np.int64)
                # x is sorted, so that a stable sort breaks ties by the shingle
                first = np.argsort(often, kind="stable")[: n + (-percent * n // 100) + 1]
                got.append(x[first].view(np.int64))
                ids.append(i)
                ns.append(n)
            if got:
                sizes = [len(g) for g in got]
                yield pa.record_batch([pa.array(np.concatenate(got)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(ns, np.int32), sizes))], names=["cell", "id", "n"])

    return arrow_map(docs, run, "cell long, id long, n int")


def parity(x: np.ndarray) -> bytes:
    """The bitmap of a set: twice as many bits as it has shingles, rounded up to a power of two."""
    bits = max(LEAST_BITS, 1 << (2 * len(x) - 1).bit_length())
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sets(docs: DataFrame) -> DataFrame:
    """Of each document its shingle hashes, sorted, as bytes, their number and their bitmap: id, n, s, bits."""

    def run(batches):
        seen: set[tuple] = set()
        for b in text_slices(batches):
            got = []
            for i, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                key = (i, len(x), *_fingerprints(x))
                if len(x) and key not in seen:  # rows that repeat one another are held once by a task
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    got.append((i, len(x), x.tobytes(), parity(x)))
            if got:
                i, n, raw, bits = zip(*got, strict=True)
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary()), pa.array(bits, pa.binary())], names=["id", "n", "s", "bits"])

    return arrow_map(docs, run, "id long, n int, s binary, bits binary")


def _small(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast if their number allows it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def measure(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b), kept in a table, with shared, the size of the intersection, and union."""

    def run(batches):
        for batch in batches:
            shared, union, last = [], [], None
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s is not last:
                    x, last = np.frombuffer(s, np.uint64), s
                y = np.frombuffer(t, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                shared.append(both)
                union.append(len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "union"])

    # Both joins read the sets by the same columns, so that they are shuffled once, and only those that are met.
    own = held.select("id", "s").join(_small(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()), "id", "left_semi")
    one = pairs.select(F.col("a").alias("id"), "b").join(own, "id").select(F.col("id").alias("a"), F.col("b").alias("id"), F.col("s").alias("x"))
    both = one.join(own, "id").select("a", F.col("id").alias("b"), "x", F.col("s").alias("y"))
    return arrow_map(both, run, "a long, b long, shared long, union long")


def linked(percent: int = PERCENT):
    return F.col("shared") * 100 >= F.col("union") * percent


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each id of the edges (a, b): id, label.

    Each round points every node to its smallest neighbour, follows these pointers three times
    and contracts the edges, until none is left.
    """
    rest = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    label = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(rest.select(F.col("b").alias("id"), F.col("a").alias("to")))
        near = saved(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("to")), "pointers")
        to = near
        for _ in range(2):
            jump = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
            to = to.join(jump, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        to = saved(to, "pointers")
        ends = to.select(F.col("id").alias("a"), F.col("to").alias("x"))
        half = rest.join(ends, "a").select("b", "x")
        left = saved(half.join(ends.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(near, rest)
        rest = left
        if label is None:
            label = saved(to.select("id", F.col("to").alias("label")), "labels")
        else:
            moved = to.select(F.col("id").alias("label"), F.col("to").alias("next"))
            new = saved(label.join(moved, "label", "left").select("id", F.coalesce("next", "label").alias("label")), "labels")
            dropped(label)
            label = new
        dropped(to)
    if label is not None:
        dropped(rest)
        return label
    return saved(rest.select(F.col("a").alias("id"), F.col("b").alias("label")), "labels")


def _crowded(members: DataFrame, percent: int) -> DataFrame:
    """Members of a cell that another one's size lets link: the next smaller or larger tells."""
    by_size = Window.partitionBy("cell").orderBy("n")
    near = members.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
    return near.where((F.col("less") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("more") * percent)).select("cell", "id", "n")


def regions_of(members: DataFrame) -> DataFrame:
    """Rows (region, id, n) from rows (cell, id, n): equal cells are one, and a region is named by its central document."""
    told = F.bit_xor(F.xxhash64("id")).over(Window.partitionBy("cell"))
    one = saved(members.withColumn("told", told).select("told", "id", "n").distinct(), "equal")
    times = one.groupBy("id").agg((-F.count("*")).alias("far"))
    lead = one.join(times, "id").groupBy("told").agg(F.min(F.struct("far", "id"))["id"].alias("region"))
    made = saved(one.join(lead, "told").select("region", "id", "n").distinct(), "regions")
    dropped(one)
    return made


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two arrays of words differ."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap as words, brought down to ``size`` bytes: parities of halves add up."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), 0)


def _within(total, percent: int):
    """The largest symmetric difference at which sets of this size together link."""
    return total * (100 - percent) // (100 + percent)


def _cut(open_: DataFrame, level: int, percent: int) -> DataFrame:
    """Regions with pivots: rows (region, id, n, bits, size, wide, lead, parts, d, star).

    parts are the pivots to whose Voronoi regions the document goes, d is its distance from the first pivot, lead,
    star whether it may link with that one, wide the longest link of the region.
    """
    # The first pivot is the central document, of which the region has its name, where that is still a member.
    first = F.struct((F.col("id") != F.col("region")).alias("other"), F.xxhash64("id").alias("h"), "id", "n", "bits")
    more = [F.min(F.struct(F.xxhash64(F.lit(level), F.lit(k), "id").alias("h"), "id", "n", "bits")) for k in range(1, PIVOTS)]
    pivots = open_.groupBy("region").agg(
        F.count("*").alias("size"), F.min(F.octet_length("bits")).alias("least"), (F.max("n") * (100 - percent) / F.lit(percent)).cast("long").alias("wide"),
        F.min(first).alias("p0"), *(m.alias(f"p{k}") for k, m in enumerate(more, 1)),
    )
    pivots = pivots.select("region", "size", "least", "wide", F.col("p0.id").alias("lead"), F.col("p0.n").alias("lead_n"), F.array(*(f"p{k}.bits" for k in range(PIVOTS))).alias("pivots"))
    kept = ["region", "id", "n", "bits", "size", "wide", "lead"]

    def run(batches):
        for b in batches:
            parts, away, star = [], [], []
            last, own = None, None
            for bits, n, least, region, lead_n, pivots in zip(*(b.column(c).to_pylist() for c in ("bits", "n", "least", "region", "lead_n", "pivots")), strict=True):
                if region != last:
                    last, own = region, np.stack([_folded(p, least) for p in pivots])
                d = _differ(own, _folded(bits, least))
                parts.append(np.flatnonzero(d <= d.min() + 2 * (n * (100 - percent) // percent)))
                away.append(int(d[0]))
                star.append(bool(d[0] <= _within(n + lead_n, percent) and min(n, lead_n) * 100 >= max(n, lead_n) * percent))
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(parts, pa.list_(pa.int32())), pa.array(away, pa.int64()), pa.array(star, pa.bool_())], names=[*kept, "parts", "d", "star"])

    return arrow_map(open_.join(pivots, "region"), run, "region long, id long, n int, bits binary, size long, wide long, lead long, parts array<int>, d long, star boolean")


def _tiles(dense: DataFrame, label: DataFrame, leaf: int) -> DataFrame:
    """Regions cut into rings around their pivot, and into tiles: the members of each two blocks that may hold a link between classes.

    What links so far (``label``) has made classes of a region's members, in a family of near copies one that
    holds most. Its members need none of one another: each of its blocks meets only blocks of the rest, and these meet
    each other. A region that is one class needs no tile, so rows grow with the members that aren't linked yet.
    """
    own = dense.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = own.groupBy("region", "label").count()
    most = sizes.groupBy("region").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("all")).where(F.col("all") > F.col("most.count"))
    most = saved(most.select("region", F.col("most.label").alias("main"), F.ceil(F.col("most.count") / leaf).alias("mains"), F.ceil((F.col("all") - F.col("most.count")) / leaf).alias("rests")), "classes")
    at = own.join(most, "region").withColumn("ring", F.floor(F.col("d") / F.greatest("wide", F.lit(1)))).withColumn("in_main", F.col("label") == F.col("main"))
    at = at.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))))
    around = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), 3 * F.col(blocks) - 1))
    other = lambda blocks: F.expr(f"(ring - 1 + k div {blocks}) * {blocks} + k % {blocks}")
    mine = lambda blocks: F.col("ring") * F.col(blocks) + F.col("block")
    main = at.where("in_main").withColumn("k", around("rests")).withColumn("tile", F.xxhash64("region", F.lit("main"), mine("mains"), other("rests")))
    rest = at.where("NOT in_main")
    to_main = rest.withColumn("k", around("mains")).withColumn("tile", F.xxhash64("region", F.lit("main"), other("mains"), mine("rests")))
    among = rest.withColumn("k", around("rests")).where((mine("rests") != other("rests")) | (F.col("rests") == 1))
    among = among.withColumn("tile", F.xxhash64("region", F.lit("rest"), F.least(mine("rests"), other("rests")), F.greatest(mine("rests"), other("rests"))))
    return functools.reduce(DataFrame.unionByName, (x.select(F.col("tile").alias("region"), "id", "n", "bits") for x in (main, to_main, among)))


def divided(members: DataFrame, percent: int = PERCENT, leaf: int = LEAF, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None, list[DataFrame]]:
    """Regions (region, id, n, bits) small enough to be joined at once: those that were so, and those made of larger ones.

    Then those that don't shrink, with the distance d from their pivot; pairs (a, b) with pivots; and the tables that these are read from.
    """
    large = lambda df: df.groupBy("region").count().where(F.col("count") > leaf).select("region")
    hot = large(members)
    if hot.isEmpty():
        return members, None, None, None, []
    small, open_ = members.join(hot, "region", "left_anti"), members.join(hot, "region")
    leaves, dense, stars, spent = [], [], [], []
    for level in range(rounds + 1):
        placed = saved(_cut(open_, level, percent), "placed")
        stars.append(placed.where("star and id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")))
        parts = placed.select("region", "size", F.explode("parts").alias("part")).groupBy("region", "size", "part").count()
        stats = parts.groupBy("region", "size").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
        shrinks = stats.where((F.col("most") <= SHRINKS * F.col("size")) & (F.col("all") <= 2 * F.col("size")) & F.lit(level < rounds)).select("region")
        dense.append(placed.join(shrinks, "region", "left_anti").select("region", "id", "n", "bits", "wide", "d"))
        cut = placed.join(shrinks, "region").withColumn("part", F.explode("parts"))
        cut = saved(cut.select(F.xxhash64("region", "part", F.lit(level)).alias("region"), "id", "n", "bits"), "parts")
        spent += [placed, cut]
        hot = large(cut)
        leaves.append(cut.join(hot, "region", "left_anti"))
        if hot.isEmpty():
            break
        open_ = cut.join(hot, "region")
    union = lambda many: functools.reduce(DataFrame.unionByName, many)
    return small, union(leaves), union(dense), union(stars), spent


def _forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (i, j) a shortest forest that spans what they connect; ``own`` are the parts connected already."""
    order = np.argsort(far, kind="stable")
    i, j, own = i[order], j[order], own.copy()
    got_i, got_j = [i[:0]], [j[:0]]
    while len(i):
        cross = own[i] != own[j]
        i, j = i[cross], j[cross]
        if not len(i):
            break
        best = np.full(int(own.max()) + 1, len(i))
        for end in (own[i], own[j]):
            np.minimum.at(best, end, np.arange(len(i)))
        pick = np.unique(best[best < len(i)])
        got_i.append(i[pick])
        got_j.append(j[pick])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for a, b in zip(own[i[pick]].tolist(), own[j[pick]].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        parts, at = np.unique(own, return_inverse=True)
        own = np.array([find(x) for x in parts.tolist()], np.int64)[at]
    return np.concatenate(got_i), np.concatenate(got_j)


def _near_pairs(region: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of a region with different labels that may link by their bitmaps, and how far they are at least. Regions stand together."""
    size = np.array([len(x) for x in bits])
    words, place = {}, {}
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size >= s)
        words[s] = np.stack([_folded(bits[r], s) for r in rows.tolist()])
        place[s] = np.zeros(len(size), np.int64)
        place[s][rows] = np.arange(len(rows))
    edge = np.flatnonzero(np.append(region[1:] != region[:-1], True))
    end = np.repeat(edge, np.diff(np.append(-1, edge)))
    live, k = np.arange(len(region)), 0
    out = [(live[:0], live[:0], np.zeros(0))]
    while True:
        k += 1
        live = live[end[live] - live >= k]
        if not len(live):
            break
        i, j = live, live + k
        ok = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        lower = np.minimum(size[i], size[j])
        for s in np.unique(lower).tolist():
            a, b = i[lower == s], j[lower == s]
            d = _differ(words[s][place[s][a]], words[s][place[s][b]])
            both = n[a] + n[b]
            near = d <= _within(both, percent)
            out.append((a[near], b[near], d[near] / both[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_pairs(members: DataFrame, label: DataFrame | None, percent: int = PERCENT, every: bool = False) -> DataFrame:
    """Distinct pairs (a, b) across labels that may link: all, or of each region a forest that connects what they connect."""
    if label is None:
        members = members.withColumn("label", F.col("id"))
    else:
        members = members.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    columns = ["region", "id", "n", "label", "bits"]

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        region, ids, n, labels = (t.column(c).to_numpy().astype(np.int64) for c in columns[:4])
        i, j, far = _near_pairs(region, n, labels, t.column("bits").to_pylist(), percent)
        if not every and len(i):
            _, own = np.unique(np.stack([region, labels]), axis=1, return_inverse=True)
            i, j = _forest(i, j, far, own.ravel())
        a, b = ids[i], ids[j]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]) if len(a) else None

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            region = t.column("region").to_numpy()
            cut = int(np.flatnonzero(region == region[-1])[0])  # the last region may go on
            rest = t.slice(cut)
            if cut and (got := pairs(t.slice(0, cut))) is not None:
                yield got
        if rest is not None and (got := pairs(rest)) is not None:
            yield got

    return arrow_map(members.select(columns).repartition("region").sortWithinPartitions("region", "id"), run, "a long, b long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, rounds: int = ROUNDS, leaf: int = LEAF) -> DataFrame:
    """One row per document: its id, n_shingles and component_id, the smallest id reachable by links."""
    texts = _docs(docs, id_col, text_col)
    made = saved(summaries(texts), "summaries")
    own = made.where("block is null").select("id", "n", "f1", "f2")
    same = own.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    classes = saved(own.join(same, ["n", "f1", "f2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep")), "classes")

    rarity = docs.sparkSession.sparkContext.broadcast(counters(made))
    dropped(made)
    shared = saved(_crowded(cells(texts, rarity, percent), percent), "cells")
    rarity.unpersist()
    reps = classes.where("n_shingles > 0 and id is not null").select("id", "rep").distinct()
    placed = regions_of(_crowded(shared.join(reps, "id").select("cell", F.col("rep").alias("id"), "n").distinct(), percent))
    dropped(shared)
    held = saved(sets(texts.join(_small(placed.select("id").distinct()), "id", "left_semi")), "sets")
    members = saved(placed.join(held.select("id", "n", "bits"), ["id", "n"]).select("region", "id", "n", "bits"), "members")
    dropped(placed)

    small, leaves, dense, stars, spent = divided(members, percent, leaf, rounds)
    label, tested, told = None, None, []

    def met(pairs: DataFrame) -> None:
        """Measures the pairs that weren't yet, and follows their links."""
        nonlocal label, tested
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        now = saved(measure(pairs, held), "measured")
        dropped(pairs)
        told.append(now)
        links = now.where(linked(percent)).select("a", "b")
        tested = now if tested is None else tested.unionByName(now)
        if label is None:
            label = components(links)
        elif not links.isEmpty():
            before = label
            label = components(links.unionByName(before.select(F.col("id").alias("a"), F.col("label").alias("b"))))
            dropped(before)

    first = near_pairs(small, None, percent)
    met(first if stars is None else first.unionByName(stars).distinct())
    hot = None
    if leaves is not None:
        hot = saved(leaves.unionByName(_tiles(dense, label, leaf)), "leaves")
        dropped(*spent)
        met(near_pairs(hot, label, percent))
    met(near_pairs(small if hot is None else small.unionByName(hot), label, percent, every=True))
    dropped(members, held, hot, *told)
    return _answer(classes, label, id_col)


def _answer(classes: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    found = classes.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "rep").alias("component_id"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, of each component only the one of smallest id; rows without words stay.

    If ids repeat or are null, it is decided by id and text: of an id's texts only those that are
    copies go, and a row without an id stays, once, only if its component has no id. Rows that
    repeat both id and text are one document, and stay or go together.
    """
    odd = docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 or id is null")
    if odd.isEmpty():
        found = join(docs, id_col, text_col, percent)
        gone = saved(found.where((F.col("n_shingles") > 0) & (F.col(id_col) != F.col("component_id"))).select(id_col).distinct(), "copies")
        return docs.join(_small(gone), id_col, "left_anti").select(docs.columns)
    key = "_id_and_text"
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    found = join(keyed, key, text_col, percent).where("n_shingles > 0").select(key, "component_id").distinct()
    named = keyed.select(key, F.col(id_col).alias("id")).distinct().join(found, key)
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", key))
    stay = named.groupBy("component_id").agg(first.alias("first")).select(f"first.{key}")
    gone = found.select(key).join(stay, key, "left_anti")
    rest = keyed.join(gone, key, "left_anti")
    rest = rest.join(found.select(key, F.lit(True).alias("worded")), key, "left")
    once = F.col(id_col).isNull() & F.col("worded").isNotNull()
    return rest.where(~once).select(docs.columns).unionByName(rest.where(once).dropDuplicates([key]).select(docs.columns))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
d AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = doc_id) AS component_id FROM s
"""
