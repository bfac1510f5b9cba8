"""Near-duplicate vectors by navigable small-world graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, staged, table
from pixelweave.llm.components import connected

COSINE = 0.98
SHARD = 4000  # vectors of a graph, about
BLOCK = 16000  # vectors that query a shard at once, about: a graph is copied once for so many
LINKS = 12  # neighbours of a vector in a layer
BEAM, WIDEST = 24, 1024
AUDIT, RECALL = 64, 0.99  # queries of a block whose answers are held against brute force, and the share they must find


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors.

    Each vector has a random top layer, a layer about 1 / LINKS of the one below it. Vectors are
    added in batches: a batch searches the graph so far, and compares its members among
    themselves; each vector links to its nearest, and is linked back by them while it is among the
    nearest of theirs. A search goes down the layers, then widens on the lowest with a beam.
    All queries of a batch take their steps together.
    """

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = x.astype(np.float32)
        rng = np.random.default_rng(seed)
        self.top = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int), 4)
        if len(x):
            self.top[0] = self.top.max()
        self.layers = [np.full((len(x), 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(self.top.max(initial=0) + 1)]
        done, size = min(1, len(x)), 1
        while done < len(x):
            self._add(np.arange(done, min(len(x), done + size)))
            done, size = done + size, min(256, done + size)

    def _add(self, new: np.ndarray) -> None:
        start = np.zeros(len(new), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            ids, sims = self._beam(self.x[new], start, k, LINKS if k else 2 * LINKS)
            start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
            here = np.flatnonzero(self.top[new] >= k)
            if not here.size:
                continue
            among = self.x[new[here]] @ self.x[new[here]].T
            np.fill_diagonal(among, -np.inf)
            every = np.concatenate([ids[here], np.broadcast_to(new[here], (len(here), len(here)))], axis=1)
            close = np.concatenate([sims[here], among], axis=1)
            width = self.layers[k].shape[1]
            for row, i in enumerate(new[here]):
                self._link(k, int(i), self._spread(every[row], close[row], width // 2))

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Near vectors, each nearer to the new one than to those chosen before it; the nearest fill up."""
        order = np.argsort(-sims, kind="stable")[: 3 * most]
        ids, sims = ids[order], sims[order]
        ok = (ids >= 0) & np.isfinite(sims)
        ids, sims = ids[ok], sims[ok]
        if len(ids) <= most:
            return ids
        own = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for j in range(len(ids)):
            if not chosen or own[j, chosen].max() < sims[j]:
                chosen.append(j)
                if len(chosen) == most:
                    break
        chosen += [j for j in range(len(ids)) if j not in set(chosen)][: most - len(chosen)]
        return ids[chosen]

    def _link(self, k: int, i: int, to: np.ndarray) -> None:
        layer = self.layers[k]
        layer[i, : len(to)] = to
        for j in to:
            row = layer[j]
            free = np.flatnonzero(row < 0)
            if i in row:
                continue
            if free.size:
                row[free[0]] = i
            else:
                both = np.append(row, i)
                keep = self._spread(both, self.x[both] @ self.x[j], len(row))
                row[:] = -1
                row[: len(keep)] = keep

    def _beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest vectors found on a layer, best first (-1 where there are fewer)."""
        layer, n = self.layers[k], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        rows = np.arange(n)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start]), True
        seen[rows, start] = True
        while (live := np.flatnonzero(open_.any(axis=1))).size:
            at = open_[live].argmax(axis=1)  # beams are sorted: the first open one is the best
            open_[live, at] = False
            near = layer[ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, ids[live, at][:, None])] = True
            s = np.where(fresh, np.einsum("nd,nkd->nk", q[live], self.x[near]), -np.inf)
            better = (s > sims[live, -1:]).any(axis=1)
            live, near, s = live[better], near[better], s[better]
            if not live.size:
                continue
            a_ids, a_s = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], s], axis=1)
            a_open = np.concatenate([open_[live], np.isfinite(s)], axis=1)
            order = np.argsort(-a_s, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(a_ids, order, 1), np.take_along_axis(a_s, order, 1)
            open_[live] = np.take_along_axis(a_open, order, 1) & np.isfinite(sims[live])
        return np.where(np.isfinite(sims), ids, -1), sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        start = np.zeros(len(q), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            ids, _ = self._beam(q, start, k, 1)
            start = ids[:, 0]
        return self._beam(q, start, 0, min(width, max(1, len(self.x))))


def within(graph: SmallWorld, q: np.ndarray, cosine: float, audit: int = AUDIT, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) at the cosine or nearer.

    A beam that is full of such vectors is doubled for its query; all beams are doubled until the
    audited queries find the share `recall` of what brute force finds, on the mean of those with a
    vector so near besides themselves. If they don't with beams of WIDEST, all queries are held
    against the whole shard.
    """
    close = cosine - 1e-5  # single precision; pairs are verified later
    checked = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    sims = q[checked].astype(np.float32) @ graph.x.T
    truth = (sims >= close) & (sims < 1 - 1e-6)
    asked = truth.sum(axis=1)
    width = BEAM
    found = [np.empty((0, 2), np.int64)] * len(q)
    todo = np.arange(len(q))
    while todo.size:
        full = []
        for part in np.array_split(todo, max(1, len(todo) // 512)):
            ids, sims = graph.search(q[part], width)
            hit = (sims >= close) & (ids >= 0)
            for r, i in enumerate(part):
                found[i] = ids[r][hit[r]]
            full.append(part[hit.all(axis=1)])
        again = np.concatenate(full) if width < len(graph.x) else np.empty(0, int)
        got = np.array([truth[k][found[i]].sum() for k, i in enumerate(checked)])
        if not again.size and (got[asked > 0] / asked[asked > 0]).sum() < recall * (asked > 0).sum():
            if width >= min(WIDEST, len(graph.x)):
                for b in range(0, len(q), 512):
                    near = q[b : b + 512].astype(np.float32) @ graph.x.T >= close
                    found[b : b + len(near)] = [np.flatnonzero(r) for r in near]
                break
            again = np.arange(len(q))
        todo, width = again, 2 * width
    n = [len(f) for f in found]
    return np.repeat(np.arange(len(q)), n), np.concatenate(found).astype(np.int64) if len(found) else np.empty(0, np.int64)


_GRAPH = "label string, own long, shards long, ids binary, vectors binary, tops binary, layers array<binary>"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _built(part: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard, as one row; it is built once, however many blocks query it."""
    part = part.sort_values("rep", ignore_index=True)
    x = _unit(np.stack(part["v"].to_numpy()))
    graph = SmallWorld(x)
    row = part.loc[:0, ["label", "own", "shards"]].copy()
    row["ids"], row["vectors"], row["tops"] = part["rep"].to_numpy(np.int64).tobytes(), x.tobytes(), graph.top.astype(np.int64).tobytes()
    row["layers"] = [[layer.tobytes() for layer in graph.layers]]
    return row


def _restored(row: pd.Series) -> tuple[np.ndarray, np.ndarray, SmallWorld]:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    graph = SmallWorld.__new__(SmallWorld)
    graph.x, graph.top = x.astype(np.float32), np.frombuffer(row["tops"], np.int64)
    graph.layers = [np.frombuffer(layer, np.int32).reshape(len(ids), -1) for layer in row["layers"]]
    return ids, x, graph


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, shard: int = SHARD
) -> DataFrame:
    """Link vectors of one label whose cosine, in double precision, is at least `cosine`.

    Equal vectors of a label form a class, stood for by its smallest id. Classes are dealt at
    random into shards of about `shard` vectors of one label; each shard gets a small-world graph,
    built once and stored, and blocks of all the label's vectors query every shard. Pairs found are verified on the
    original vectors. Vectors that are null, zero or hold null or non-finite components, or whose
    label is null, link with nothing; nor do vectors of different lengths.

    Returns one row per input row: id, n_links (other vectors linked directly), component_id (the
    smallest id reachable by links) and kept. Rows that repeat an id count as further vectors of
    that id. Null ids get no links; ids must be whole numbers.
    """
    rows = ids_only(vectors, id=vec_id, v=vector, label=label).withColumns(
        {"id": F.col("id").cast("long"), "v": F.col("v").cast("array<double>")}
    )
    usable = rows.where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    keyed = usable.select("id", "label", "v", F.struct(F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "label", "v")).alias("key"))
    classes = staged(keyed.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    counts = staged(classes.groupBy("label").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard)))
    dealt = classes.join(counts.select("label", "shards"), "label").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shards")))
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / largest)  # so that no square over- or underflows
    dealt = staged(dealt.select("rep", F.concat_ws("/", F.col("label").cast("string"), F.size("v")).alias("label"), scaled.alias("v"), "own", "shards"))
    graphs = staged(dealt.groupBy("label", "own", "shards").applyInPandas(_built, _GRAPH))
    # every block of queries, the vectors of some shards, meets every graph of its label
    blocks = F.ceil(F.col("shards") * shard / BLOCK).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    asks = dealt.select("rep", "label", "v", every.alias("shard"), F.pmod(F.col("own"), blocks).alias("block"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    holds = graphs.select("label", F.col("own").alias("shard"), parts.alias("block"), "ids", "vectors", "tops", "layers")
    keys = ["label", "shard", "block"]

    def search(graph: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(part):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        ids, x, small_world = _restored(graph.iloc[0])
        part = part.sort_values("rep", ignore_index=True)
        q = _unit(np.stack(part["v"].to_numpy()))
        i, j = within(small_world, q, cosine)
        exact = np.concatenate([(q[s] * x[t]).sum(axis=1) for s, t in zip(np.array_split(i, len(i) // 20000 + 1), np.array_split(j, len(i) // 20000 + 1), strict=True)])
        u, w = part["rep"].to_numpy()[i], ids[j]
        keep = (exact >= cosine) & (u != w)
        return pd.DataFrame({"u": np.minimum(u, w)[keep], "v": np.maximum(u, w)[keep]}).drop_duplicates()

    grouped = holds.groupBy(*keys).cogroup(asks.groupBy(*keys))
    pairs = staged(grouped.applyInPandas(search, "u long, v long").distinct())
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    copies = classes.select(F.col("rep").alias("v"), "copies")
    near = both.join(copies, "v").groupBy("u").agg(F.sum("copies").alias("near"))
    of = connected(pairs)
    per_class = staged(
        classes.select("rep", "copies", "label", F.col("v").alias("vector"))
        .join(near.withColumnRenamed("u", "rep"), "rep", "left").join(of.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.struct(F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "label", "vector")).alias("key"),
            (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = keyed.select("id", "key").join(per_class, "key").select("id", "n_links", "component_id")
    rest = rows.join(usable.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
