"""Approximate nearest neighbours by inner product: a graph by NN-descent, searched greedily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm._common import dropped, ids_only, small_batches, staged, table

TOP = 20
DEGREE, BACK = 28, 12  # neighbours a node keeps, and nodes that name it, in the graph that is searched
SHARD = 1 << 16  # nodes of a graph, about; a larger table has several, and each query searches all
CELL, FORESTS = 400, 3  # nodes of a cell, about; cells come from random hyperplanes, and start the graph, so many times
ROUNDS, STILL = 6, 0.05  # NN-descent ends when fewer than this share of neighbours changed
BEAM, WIDEST = 128, 2048
SEEDS = 32  # nodes anywhere in a graph that each search begins with besides its own place
BLOCK = 512  # queries that search a graph together
COPIED, TASKS = 16, 16  # blocks that one copy of a shard serves, where that leaves as many tasks as this
SLICE = 2000  # nodes of a shard in a row: a shard is never one row, or Spark holds several copies of it in memory
AUDIT, RECALL = 16, 0.97  # queries of a block held against brute force, and the share they must find before the beam is widened no more

_WIDTH = DEGREE + BACK
_GRAPH = "u long, cell long, vec binary, ids array<long>, scores array<float>, new array<boolean>"


def _vecs(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                yield f(batch.slice(s, 2000))

    return df.mapInArrow(run, schema)


def _best_of(u: np.ndarray, w: np.ndarray, s: np.ndarray, keep: int) -> pa.Table:
    """Of each u its `keep` best distinct w, as lists."""
    order = np.lexsort((w, -s, u))
    u, w, s = u[order], w[order], s[order]
    new = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]))[: len(u)]  # equal pairs have equal scores
    u, w, s = u[new], w[new], s[new]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])[: len(u)])
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    u, w, s = u[rank < keep], w[rank < keep], s[rank < keep]
    nodes, counts = np.unique(u, return_counts=True)
    return pa.table({"u": nodes, "ids": _lists(w, counts), "scores": _lists(s.astype(np.float32), counts)})


def _within(part: pa.Table) -> pa.Table:
    """Each node's nearest in its cell."""
    x, ids = _vecs(part.column("vec").combine_chunks()), part.column("u").to_numpy()
    out, k = [], min(DEGREE, len(ids) - 1)
    for b in range(0, len(ids) if k > 0 else 0, 500):
        s = x[b : b + 500] @ x.T
        s[np.arange(len(s)), np.arange(b, b + len(s))] = -np.inf
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append(_best_of(np.repeat(ids[b : b + 500], k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel(), k))
    return pa.concat_tables(out) if out else _best_of(ids[:0], ids[:0], np.empty(0, np.float32), 1)


def _joined(lists: pa.Table, wanted: pa.Table) -> pa.Table:
    """The local join of a cell: the neighbours of each of its nodes meet each other, where one of two is new.
    Of each neighbour the best of what it met and what beats its worst one."""
    ids = wanted.column("id").to_numpy()
    order = np.argsort(ids)
    ids, floor = ids[order], wanted.column("floor").to_numpy()[order]
    x = _vecs(wanted.column("vec").combine_chunks())[order] if len(ids) else np.empty((0, 1), np.float32)
    flat, new = (lists.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "new"))
    counts = lists.column("ids").combine_chunks().value_lengths().to_numpy()
    begin = np.cumsum(counts) - counts
    best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    width = int(counts.max(initial=0))
    for b in range(0, len(counts), 250):
        n = counts[b : b + 250]
        at = begin[b : b + 250, None] + np.arange(width)
        there = np.arange(width) < n[:, None]
        at = np.where(there, at, 0)
        m, fresh = np.searchsorted(ids, flat[at]), new[at] & there
        v = x[np.minimum(m, len(ids) - 1)]
        s = v @ v.transpose(0, 2, 1)
        ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (m[:, :, None] != m[:, None, :])
        r, i, j = np.nonzero(ok & (s > floor[np.minimum(m, len(ids) - 1)][:, :, None]))
        best.append((ids[m[r, i]], ids[m[r, j]], s[r, i, j]))
    return _best_of(*(np.concatenate(c) for c in zip(*best, strict=True)), DEGREE)


def _kept(ids: list, scores: list, flags: np.ndarray, more: list | None, more_scores: list | None, flag: bool, width: int) -> tuple[np.ndarray, ...]:
    """The best of a list with flags and of more candidates, which get the flag given."""
    i = np.array(ids + (more or []), np.int64)
    s = np.array(scores + (more_scores or []), np.float32)
    f = np.concatenate([flags, np.full(len(i) - len(flags), flag)])
    _, first = np.unique(i, return_index=True)  # the first of equals: the old one
    first = first[np.lexsort((i[first], -s[first]))][:width]
    return i[first], s[first], f[first]


def _improved(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The graph after a round: what was there is no longer new."""
    out, counts = ([], [], []), []
    cols = (batch.column(c).to_pylist() for c in ("ids", "scores", "more", "more_scores"))
    for ids, scores, more, more_scores in zip(*cols, strict=True):
        kept = _kept(ids or [], scores or [], np.zeros(len(ids or []), bool), more, more_scores, True, DEGREE)
        for o, x in zip(out, kept, strict=True):
            o.append(x)
        counts.append(len(kept[0]))
    flat = [np.concatenate(o) for o in out]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "cell", "vec")), *(_lists(x, np.array(counts)) for x in flat)], names=["u", "cell", "vec", "ids", "scores", "new"])


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    got = found.groupBy("u").agg(F.flatten(F.collect_list("ids")).alias("more"), F.flatten(F.collect_list("scores")).alias("more_scores"))
    return staged(_mapped(graph.join(got, "u", "left"), _improved, _GRAPH))


def _backwards(forth: DataFrame, seed: int = 0) -> DataFrame:
    """A hashed choice of about BACK of the edges (node, nb) that lead to each nb. Counts bound what a hub gets."""
    named = forth.groupBy("nb").agg(F.count("*").alias("times"))
    return forth.join(named, "nb").where(F.pmod(F.xxhash64("node", "nb", F.lit(seed)), "times") < BACK).drop("times")


def _packed(part: pa.Table) -> pa.Table:
    """One shard in rows of SLICE nodes: ids in order, vectors, and each node's neighbours by their places (-1: none)."""
    ids = part.column("u").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    near = part.column("near").combine_chunks().fill_null([])
    counts, flat = near.value_lengths().to_numpy(), near.flatten().to_numpy()
    graph = np.full((len(ids), _WIDTH), -1, np.int32)
    row = np.repeat(np.arange(len(ids)), counts)
    graph[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.searchsorted(ids, flat)
    x = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    graph, cuts = graph[order], range(0, len(ids), SLICE)
    made = {"shard": [part.column("shard")[0].as_py()] * len(cuts), "slice": [*cuts]}
    made |= {k: [v[c : c + SLICE].tobytes() for c in cuts] for k, v in (("ids", ids), ("vectors", x), ("graph", graph))}
    return pa.table({k: pa.array(v, pa.int64() if k in ("shard", "slice") else pa.binary()) for k, v in made.items()})


def greedy(graph: np.ndarray, x: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Greedy search for the nodes of largest inner product, all queries step by step together: (query, width) places, best first, -1 where fewer.

    Each query keeps a beam, expands its best unexpanded node, and ends when there is none.
    """
    n, rows = len(q), np.arange(len(q))
    seen = np.zeros((n, len(x)), bool)
    seen[rows[:, None], starts] = True
    first = np.einsum("nd,nkd->nk", q, x[starts])
    first[:, 1:][starts[:, 1:] == starts[:, :1]] = -np.inf  # a query's own place may be a seed
    pad = max(0, width - starts.shape[1])
    ids = np.pad(starts.astype(np.int64), ((0, 0), (0, pad)), constant_values=-1)
    sims = np.pad(first, ((0, 0), (0, pad)), constant_values=-np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    wait = np.isfinite(sims)
    while (live := np.flatnonzero(wait.any(axis=1))).size:
        at = wait[live].argmax(axis=1)  # beams are sorted: the first that waits is the best
        wait[live, at] = False
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, ids[live, at][:, None])] = True
        s = np.where(fresh, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -np.inf)
        better = (s > sims[live, -1:]).any(axis=1)
        live, near, s = live[better], near[better], s[better]
        if live.size:
            every, scores = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], s], axis=1)
            waits = np.concatenate([wait[live], np.isfinite(s)], axis=1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1)
            wait[live] = np.take_along_axis(waits, order, 1) & np.isfinite(sims[live])
    return np.where(np.isfinite(sims), ids, -1)


def _ranked(x: np.ndarray, q: np.ndarray, places: np.ndarray, ids: np.ndarray, own: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query's places the `keep` best by the product in double precision, ties to smaller ids, without the query itself."""
    s = np.stack([x[p].astype(np.float64, copy=False) @ v for p, v in zip(places, q, strict=True)])
    s = np.where((places < 0) | (ids[places] == own[:, None]), -np.inf, s)
    order = np.lexsort((ids[places], -s), axis=1)[:, :keep]
    return np.take_along_axis(places, order, 1), np.take_along_axis(s, order, 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in single precision over the length of the longest one, worked out in double precision, some at a time."""
    parts = [slice(k, k + 4096) for k in range(0, len(x), 4096)]
    double = lambda c: x[c].astype(np.float64, copy=False)
    long = max(1e-300, *(float(np.sqrt((double(c) ** 2).sum(1).max())) for c in parts))
    out = np.empty(x.shape, np.float32)
    for c in parts:
        out[c] = double(c) / long
    return out


def _answers(top: int, keep: int, beam: int, recall: float, kind: type):
    """Searches of blocks of queries in one shard, whose vectors are numbers of this kind: (u, w, s, audit)."""

    def block(ids: np.ndarray, x: np.ndarray, small: np.ndarray, graph: np.ndarray, own: np.ndarray, q: np.ndarray) -> pa.Table:
        order = np.argsort(own)
        own, q = own[order], q[order]
        ask = (q / np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-300)).astype(np.float32)
        home = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        seeds = np.linspace(0, len(ids) - 1, min(SEEDS, len(ids))).astype(int)
        starts = np.concatenate([np.where(ids[home] == own, home, seeds[0])[:, None], np.broadcast_to(seeds, (len(q), len(seeds)))], axis=1)
        checked = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))

        def scanned(at: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
            each = [_ranked(x, q[at[b : b + 4]], np.broadcast_to(np.arange(len(ids)), (len(at[b : b + 4]), len(ids))), ids, own[at[b : b + 4]], keep) for b in range(0, len(at), 4)]
            return tuple(np.concatenate(c) for c in zip(*each, strict=True))

        truth = scanned(checked, top)
        width = min(beam, len(ids))
        while True:
            found = np.concatenate([greedy(graph, small, ask[b : b + 128], starts[b : b + 128], width) for b in range(0, len(q), 128)])
            places, s = _ranked(x, q, found, ids, own, keep)
            there = np.isfinite(truth[1])
            hits = sum(np.isin(t[ok], p[:top]).sum() for t, ok, p in zip(truth[0], there, places[checked], strict=True))
            audit = hits / max(1, there.sum())
            if audit >= recall or width >= min(WIDEST, len(ids)):
                break
            width *= 2
        if audit < recall:  # a block's queries against a shard: bounded
            places, s = scanned(np.arange(len(q)), keep)
        ok = np.isfinite(s)
        mine = np.flatnonzero(ids[home] == own)
        n = int(ok.sum()) + len(mine)
        return pa.table({
            "u": np.append(np.repeat(own, ok.sum(1)), own[mine]), "w": np.append(ids[places[ok]], own[mine]),
            "s": np.append(s[ok], (q[mine] * q[mine]).sum(1)), "audit": np.full(n, audit),
        })

    def run(held: pa.Table, asks: pa.Table) -> pa.Table:
        empty = pa.table({"u": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "audit": pa.array([], pa.float64())})
        if not held.num_rows or not asks.num_rows:
            return empty
        held = held.sort_by("slice")
        joined = lambda c, kind: np.frombuffer(b"".join(held.column(c).to_pylist()), kind)
        ids = joined("ids", np.int64)
        x, graph = joined("vectors", kind).reshape(len(ids), -1), joined("graph", np.int32).reshape(len(ids), -1)
        small, out = _scaled(x), [empty]
        own, q = asks.column("u").to_numpy(), asks.column("v").combine_chunks().flatten().to_numpy().reshape(asks.num_rows, -1)
        number = asks.column("block").to_numpy()
        for b in np.unique(number).tolist():
            at = np.flatnonzero(number == b)
            out.append(block(ids, x, small, graph, own[at], q[at]))
        return pa.concat_tables(out)

    return run


def _freed(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of rounds that are over: it does so when the JVM collects their plans."""
    spark.sparkContext._jvm.System.gc()


def _celled(nodes: DataFrame, count: int, forest: int) -> DataFrame:
    """Nodes (u, shard, vec) with a cell of about CELL near ones of their shard: a side of each of some hyperplanes. Large cells are dealt at random."""
    bits = max(0, int(np.ceil(np.log2(max(1, min(count, SHARD)) / CELL))))

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _vecs(batch.column("vec"))
        side = x @ np.random.default_rng([3, forest]).normal(size=(x.shape[1], bits)) > 0
        code = (side @ (1 << np.arange(bits)) if bits else np.zeros(len(x))).astype(np.int64)
        code += batch.column("shard").to_numpy() << bits
        return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("vec"), pa.array(code)], names=["u", "vec", "code"])

    coded_nodes = _mapped(nodes, coded, "u long, vec binary, code long")
    sizes = coded_nodes.groupBy("code").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    cell = F.col("code") * 2**24 + F.pmod(F.xxhash64("u"), "parts")
    return coded_nodes.join(sizes, "code").select("u", "vec", cell.alias("cell"))


def descent(nodes: DataFrame, count: int, *, rounds: int = ROUNDS, still: float = STILL, trace: list[DataFrame] | None = None) -> DataFrame:
    """A neighbour graph over nodes (u, [shard,] vec) by NN-descent: (u, cell, vec, ids, scores, new).

    It starts from the nearest within cells of random hyperplanes, which lie in one shard each; so
    does the graph then, and a hub is named from no more than a shard's cells. In each round the neighbours of
    a node, and some of the nodes that name it, are neighbours of neighbours: Spark joins bring
    their vectors to the node's cell, where each pair with a new member is compared, and another
    join takes what beats the worst neighbour of either back to it. `trace` gets the graph after
    each round, and then keeps the tables.
    """
    spark = nodes.sparkSession
    nodes = nodes if "shard" in nodes.columns else nodes.withColumn("shard", F.lit(0).cast("long"))
    homes = staged(_celled(nodes, count, 0))
    kind = "u long, ids array<long>, scores array<float>"
    lists = homes.groupBy("cell").applyInArrow(_within, kind)
    for forest in range(1, FORESTS):
        lists = lists.unionByName(_celled(nodes, count, forest).groupBy("cell").applyInArrow(_within, kind))
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("scores", "float"))]
    graph = _merged(homes.select("u", "cell", "vec", *empty), lists)
    for turn in range(rounds):
        forth = graph.select(F.col("u").alias("node"), F.explode(F.arrays_zip("ids", "new")).alias("x")).select("node", F.col("x.ids").alias("nb"), F.col("x.new").alias("new"))
        back = _backwards(forth, turn).groupBy(F.col("nb").alias("u")).agg(F.collect_list(F.struct(F.col("node").alias("ids"), "new")).alias("back"))
        every = F.concat(F.arrays_zip("ids", "new"), F.coalesce("back", F.array().cast("array<struct<ids: long, new: boolean>>")))
        members = graph.join(back, "u", "left").select("cell", every.alias("m")).where(F.exists("m", lambda x: x["new"]))
        members = staged(members.select("cell", F.col("m.ids").alias("ids"), F.col("m.new").alias("new")))
        floor = F.when(F.size("scores") >= DEGREE, F.array_min("scores")).otherwise(F.lit(float("-inf"))).cast("float")
        wanted = members.select(F.col("cell").alias("home"), F.explode("ids").alias("id")).repartition("id").distinct()
        wanted = wanted.join(graph.select(F.col("u").alias("id"), "vec", floor.alias("floor")), "id").select("home", "id", "vec", "floor")
        found = members.groupBy("cell").cogroup(wanted.groupBy("home")).applyInArrow(_joined, kind)
        old, graph = graph, _merged(graph, found)
        dropped(members)
        if trace is None:
            dropped(old)
        else:
            trace.append(graph)
        _freed(spark)
        if (graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0) < still * DEGREE * count:
            break
    return graph


def nearest(
    vectors: DataFrame, queries: F.Column, *, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, beam: int = BEAM, recall: float = RECALL
) -> DataFrame:
    """The `top` rows of largest inner product for each query row, nearest first.

    `queries` is a condition on the column `id`. Equal vectors form a class, stood for by its
    smallest id. Classes are dealt at random into shards of at most about SHARD nodes; NN-descent
    builds a graph over each shard, all shards in the same joins, in a space with one more component
    that makes all lengths equal, so that near means a large inner product. Queries search the
    shards in blocks, COPIED of which share a copy of a shard, greedily, from their own class's place and a few seeds, on vectors of single
    precision; whole beams are then scored in double precision on the original vectors. Of each block
    AUDIT queries are held against brute force, and the beam is doubled until they find the share
    `recall`; if they don't at the widest, the block is answered by a product with its shard. Of a class
    only the `top` + 1 smallest ids can appear.

    Returns query_id, rank (from 1), vec_id, score and audit, the mean recall that the audits of the
    query's blocks found for their searches. Ties go to the smaller vec_id. Vectors that are null,
    zero, or hold null or non-finite components, or have another number of components than most, take
    no part, nor do null ids; ids must be whole numbers; rows that repeat an id count once. Other
    columns are ignored, whatever their names, and an empty table gives an empty result.
    """
    with small_batches(vectors.sparkSession):
        return _nearest(vectors, queries, vec_id, vector, top, beam, recall)


def _nearest(vectors: DataFrame, queries: F.Column, vec_id: str, vector: str, top: int, beam: int, recall: float) -> DataFrame:
    spark = vectors.sparkSession
    rows = ids_only(vectors, id=vec_id, v=vector)
    single = dict(rows.dtypes)["v"] == "array<float>"
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    usable = rows.where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    seen = usable.agg(F.mode(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    schema = "query_id long, rank int, vec_id long, score double, audit double"
    if seen["d"] is None:
        return spark.createDataFrame([], schema)
    usable = staged(usable.where(F.size("v") == seen["d"]).withColumn("key", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))).dropDuplicates(["id"]))
    classes = staged(usable.groupBy("key").agg(F.min("id").alias("u"), F.any_value("v").alias("v")))
    longest = float(np.sqrt(seen["m"]))

    count = classes.count()
    shards = max(1, -(-count // SHARD))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) / longest
        flat = np.append(x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True))), axis=1).astype(np.float32)
        return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("shard"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["u", "shard", "vec"])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "u"), F.lit(shards)))
    nodes = staged(_mapped(dealt.select("u", "shard", "v"), spread, "u long, shard long, vec binary"))
    graph = descent(nodes, count)
    forth = graph.select(F.col("u").alias("node"), F.explode("ids").alias("nb"))
    back = _backwards(forth).select(F.col("nb").alias("node"), F.col("node").alias("nb"))
    edges = forth.withColumn("rank", F.lit(0)).unionByName(back.withColumn("rank", F.lit(1))).groupBy("node", "nb").agg(F.min("rank").alias("rank"))
    each = F.sort_array(F.collect_list(F.struct("rank", F.xxhash64("nb").alias("h"), "nb")))
    near = edges.groupBy(F.col("node").alias("u")).agg(F.transform(F.slice(each, 1, _WIDTH), lambda e: e["nb"]).alias("near"))
    held = F.col("v").cast("array<float>" if single else "array<double>").alias("v")  # no longer than they came
    packed = dealt.join(near, "u", "left").select("u", "shard", held, "near").groupBy("shard")
    worlds = staged(packed.applyInArrow(_packed, "shard long, slice long, ids binary, vectors binary, graph binary"))
    asking = usable.where(queries).select(F.col("id").alias("query_id"), "key")
    asks = staged(asking.select("key").distinct().join(classes, "key").select("u", "v"))
    blocks = max(1, -(-asks.count() // BLOCK))
    groups = min(blocks, max(-(-blocks // COPIED), -(-TASKS // shards)))
    block = F.pmod(F.xxhash64(F.lit(11), "u"), F.lit(blocks)).cast("long")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = worlds.withColumn("group", up_to(groups))
    right = asks.select("u", "v", block.alias("block"), (block % groups).alias("group"), up_to(shards).alias("shard"))
    answers = _answers(top, 2 * top, beam, recall, np.float32 if single else np.float64)
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(answers, "u long, w long, s double, audit double")
    found = staged(found)
    audits = found.groupBy("u").agg(F.avg("audit").alias("audit"))
    # the best classes, and the query's own: its copies
    best = Window.partitionBy("u").orderBy((F.col("w") == F.col("u")).desc(), F.desc("s"), "w")
    ranked = found.drop("audit").withColumn("r", F.row_number().over(best)).where(f"r <= {2 * top + 1}").join(audits, "u")
    order = Window.partitionBy("key").orderBy("id")
    members = staged(usable.select("key", "id").withColumn("r", F.row_number().over(order)).where(f"r <= {top + 1}").drop("r"))
    scored = (
        ranked.join(classes.select(F.col("u").alias("w"), F.col("key").alias("k2")), "w").join(classes.select("u", "key"), "u")
        .select("key", "k2", F.col("s").alias("score"), "audit")
    )
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(scored, "key").drop("key")
        .join(members.select(F.col("key").alias("k2"), F.col("id").alias("vec_id")), "k2").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score", "audit")
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
