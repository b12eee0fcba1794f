"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node. Nodes are dealt to shards of bounded size by a hash. In a shard,
points join the graph in growing batches: a greedy beam search proposes neighbours, relaxed
distance pruning keeps diverse edges, and reverse edges are pruned the same way. Blocks of
queries beam-search every shard; what is found is ranked by exact cosine in double precision.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part;
only vectors of equal length are compared; a query has no row if there is no other vector; ties
go to the smaller id; repeated rows count once, and rows of the query's own id never answer it;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .textarrays import arrow_map

DEGREE = 24
BEAM = 48
#: Width of a search: the root of the shard's size, at least this.
SEARCH_BEAM = 96
ALPHA = 1.2
#: Nodes of a shard: a twelfth of all between these bounds. Every query visits every shard, so shards are few while
#: a task can hold them; a beam search takes little longer in a larger one.
SHARDS = 12
LEAST_SHARD, MOST_SHARD = 8192, 65_536
BLOCK = 512
#: Nodes whose edges a beam search follows at once.
WIDTH = 4


def usable(vector):
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def beam_search(data: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query (B, beam), best first, and their similarities; -1 fills up."""
    b, n = len(queries), len(data)
    ids = np.full((b, beam), -1, np.int32)
    near = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    ids[:, 0], near[:, 0], done[:, 0] = entry, queries @ data[entry], False
    seen[:, entry] = seen[:, n] = True
    live = np.arange(b)
    while len(live):
        open_ = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-open_, min(width, beam) - 1, axis=1)[:, :width]
        ok = np.take_along_axis(open_, pick, 1) > -np.inf
        alive = ok.any(1)
        live, pick, ok = live[alive], pick[alive], ok[alive]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] = True
        nodes = np.where(ok, ids[rows, pick], n)
        nbr = graph[nodes].reshape(len(live), -1)
        new = ~seen[rows, nbr]
        # the same neighbour of two nodes counts once
        order = np.argsort(nbr, axis=1, kind="stable")
        same = np.take_along_axis(nbr, order, 1)
        twice = np.zeros_like(new)
        np.put_along_axis(twice, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
        new &= ~twice
        seen[rows, nbr] = True
        r, c = np.nonzero(new)
        sim = np.full(nbr.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("ij,ij->i", data[nbr[r, c]], queries[live[r]])
        all_ids = np.concatenate([ids[live], np.where(new, nbr, -1)], 1)
        all_near = np.concatenate([near[live], sim], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, top, 1)
        near[live] = np.take_along_axis(all_near, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(data: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1: none): the nearest, and those not much nearer to one kept."""
    n = len(data)
    x, c = data[points], data[np.where(cand < 0, 0, cand)]
    far = 2 - 2 * np.einsum("bd,bcd->bc", x, c)
    far[(cand < 0) | (cand == points[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    cand, far, c = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(c, order[:, :, None], 1)
    far[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
    between = 2 - 2 * np.matmul(c, c.transpose(0, 2, 1))
    out = np.full((len(points), degree), n, np.int32)
    alive = np.isfinite(far)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        first = np.argmax(alive, 1)
        out[has, k] = cand[has, first[has]]
        row = np.arange(len(points))
        alive &= ~(alpha * between[row, first] <= far)
        alive[row, first] = False
    return out


def build(data: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph over unit vectors, (n + 1, degree) with n for no edge, and its entry."""
    n = len(data)
    graph = np.full((n + 1, degree), n, np.int32)
    entry = int(np.argmax(data @ data.mean(0)))
    todo = np.random.default_rng(n).permutation(n)
    todo = todo[todo != entry]
    start, size = 0, 1
    for again in (False, True):  # the second pass gives early points the neighbours that came later
        start, size = (0, size) if not again else (0, BLOCK)
        while start < len(todo):
            points = todo[start : start + size]
            start, size = start + len(points), min(2 * size, BLOCK)
            found, _ = beam_search(data, graph, entry, data[points], beam)
            own = graph[points]
            cand = np.concatenate([found, np.where(own == n, -1, own)], 1)
            graph[points] = robust_prune(data, points, cand, degree, alpha)
            src, dst = np.repeat(points, degree), graph[points].ravel()
            src, dst = src[dst < n], dst[dst < n]
            order = np.lexsort((-np.einsum("ij,ij->i", data[src], data[dst]), dst))
            src, dst = src[order], dst[order]
            heads = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.zeros(0, int)
            into = dst[heads]
            place = np.arange(len(dst)) - np.repeat(heads, np.diff(np.append(heads, len(dst))))
            back = np.full((len(into), 2 * degree), -1, np.int32)
            keep = place < 2 * degree
            back[np.searchsorted(into, dst[keep]), place[keep]] = src[keep]
            for a in range(0, len(into), BLOCK):
                part = into[a : a + BLOCK]
                own = graph[part]
                graph[part] = robust_prune(data, part, np.concatenate([np.where(own == n, -1, own), back[a : a + BLOCK]], 1), degree, alpha)
    return graph, entry


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two arrays, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _raw(lists: pa.Array) -> list[bytes]:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
    return [flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]


def _usable(vectors: DataFrame) -> DataFrame:
    # adding 0 turns -0.0 into 0.0, so that equal vectors have equal bytes
    own = vectors.where("vec_id is not null").where(usable(F.col("embedding")))
    return own.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def packed(vectors: DataFrame) -> DataFrame:
    """The usable vectors as bytes: vec_id, dim, raw."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_raw(b.column(1)), pa.binary())], names=["vec_id", "raw"])

    own = arrow_map(_usable(vectors), run, "vec_id long, raw binary")
    return own.select("vec_id", (F.octet_length("raw") / 8).cast("int").alias("dim"), "raw")


def nodes(vectors: DataFrame, keep: int) -> DataFrame:
    """Distinct usable vectors with their smallest ``keep`` ids: node, dim, raw, ids.

    A task first joins equal vectors of its own rows, so a vector that is very common reaches the
    shuffle once from each task.
    """

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), _raw(b.column(1)), strict=True):
                own = held.setdefault(raw, [])
                if i not in own:
                    own.append(i)
                    own.sort()
                    del own[keep:]
        parts = list(held.items())
        for k in range(0, len(parts), 4096):
            yield pa.record_batch([pa.array([p[0] for p in parts[k : k + 4096]], pa.binary()), pa.array([p[1] for p in parts[k : k + 4096]], pa.list_(pa.int64()))], names=["raw", "ids"])

    few = arrow_map(_usable(vectors), run, "raw binary, ids array<long>").groupBy("raw").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    few = few.select("raw", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep).alias("ids"))
    return few.select(F.col("ids")[0].alias("node"), (F.octet_length("raw") / 8).cast("int").alias("dim"), "raw", "ids")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int | None = None, beam: int = SEARCH_BEAM) -> DataFrame:
    """For each row of queries (vec_id, embedding) its k nearest in vectors: query_id, rank, vec_id, score."""
    own = saved(nodes(vectors, k + 1), "nodes")
    n = own.count()
    n_shards = max(1, math.ceil(n / (shard or min(max(n / SHARDS, LEAST_SHARD), MOST_SHARD))))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("raw"), F.lit(n_shards)).cast("int"))

    def index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        data = np.frombuffer(b"".join(rows["raw"]), np.float64).reshape(len(rows), -1)
        graph, entry = build(_unit(data))
        ids = np.full((len(rows), k + 1), -1, np.int64)
        for i, x in enumerate(rows["ids"]):
            ids[i, : len(x)] = x
        return pd.DataFrame([[key[0], key[1], data.tobytes(), graph.tobytes(), entry, ids.tobytes()]])

    # Told how many partitions, Spark doesn't merge the small ones: each shard is built by a task of its own.
    dealt = dealt.repartition(4 * n_shards, "dim", "shard")
    graphs = dealt.groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, data binary, graph binary, entry int, ids binary")
    asked = packed(queries).select("dim", "raw", F.col("vec_id").alias("query_id")).distinct()
    n_blocks = max(1, math.ceil(queries.select("vec_id").count() / BLOCK))
    blocks = asked.groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct("query_id", "raw")).alias("asked")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def run(batches):
        for b in batches:
            for row in b.slice(0).to_pylist():
                dim = row["dim"]
                data = np.frombuffer(row["data"], np.float64).reshape(-1, dim)
                graph = np.frombuffer(row["graph"], np.int32).reshape(len(data) + 1, -1)
                ids = np.frombuffer(row["ids"], np.int64).reshape(len(data), -1)
                unit = _unit(data)
                for a in range(0, len(row["asked"]), BLOCK):
                    part = row["asked"][a : a + BLOCK]
                    x = np.frombuffer(b"".join(p["raw"] for p in part), np.float64).reshape(-1, dim)
                    found, _ = beam_search(unit, graph, row["entry"], _unit(x), min(max(beam, math.isqrt(len(data))), max(len(data), k + 1)))
                    r, c = np.nonzero(found[:, : k + 1] >= 0)
                    node = found[r, c]
                    score = cosine(x[r], data[node])
                    who = np.array([p["query_id"] for p in part])[r]
                    which = ids[node]
                    ok = (which >= 0) & (which != who[:, None])
                    times = ok.sum(1)
                    yield pa.record_batch([pa.array(np.repeat(who, times)), pa.array(which[ok]), pa.array(np.repeat(score, times))], names=["query_id", "vec_id", "score"])

    pairs = arrow_map(blocks.join(graphs, ["dim", "shard"]), run, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))
