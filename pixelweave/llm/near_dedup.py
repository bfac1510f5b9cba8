"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, kind_of, map_arrow, mixed, staged, table, text_bytes
from pixelweave.llm.components import connected

WORDS, SIMILARITY = 5, 0.8
CELLS = 64  # of the bound on what two texts have in common; a power of two
BANDS, ROWS = 28, 5  # a pair at similarity 0.8 misses all bands with probability 1.5e-5
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_K, _K_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_U = np.uint64


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and the text of each word.

    A word is a longest run of bytes without ASCII white space. Prefix sums of a polynomial give
    the hash of any run; the end of a text also ends a word.
    """
    n = len(data)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begin[edge] |= solid[edge]
    ends[edge - 1] |= solid[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _K, _U)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=sums[1:])
        inverse = np.full(n + 1, _K_INV, _U)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U)
    return mixed(h), np.searchsorted(offsets, s, side="right") - 1


def shingle_counts(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash, count). A shorter text has one shingle, all its words."""
    h, doc = word_hashes(data, offsets)
    texts = len(offsets) - 1
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    at = np.arange(len(h)) - first[doc]
    starts = np.flatnonzero(at <= np.maximum(n[doc] - words, 0))
    s = np.zeros(len(starts), _U)
    with np.errstate(over="ignore"):
        for k in range(words):
            i = np.minimum(starts + k, len(h) - 1)
            inside = (at[starts] + k) < n[doc[starts]]
            s = np.where(inside, mixed(s + h[i] * _U(2 * k + 1)), s)
    d = doc[starts]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    i = np.flatnonzero(new)
    return d[i], s[i], np.diff(np.append(i, len(s)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """BagMinHash signatures of multisets with integer weights.

    The weights are cut into the levels [0, 1), [1, 2), [2, 4), [4, 8), ...; each element has a
    Poisson process of points on each level, at a rate equal to the level's height, seeded by the
    element and the level alone. A point carries a slot and a height below which the weight must
    reach for it to count. A slot keeps the element of its earliest point, so two slots agree with
    the probability of the weighted Jaccard similarity. Points beyond the time by which a text's
    slots are likely to be full aren't drawn; texts with an open slot are drawn on.
    """
    total = np.bincount(doc, weights=weight, minlength=texts)
    levels = [(np.arange(len(doc)), 0)]
    j = 1
    while (i := np.flatnonzero(weight > (1 << (j - 1)))).size:
        levels.append((i, j))
        j += 1
    who = np.concatenate([i for i, _ in levels])
    level = np.concatenate([np.full(len(i), j) for i, j in levels])
    base = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(base, 1).astype(float)
    d, w = doc[who], weight[who]
    with np.errstate(over="ignore"):
        seed = mixed(element[who] + level.astype(_U) * _U(_K))
    keep = (mixed(element) >> _U(32))[who]  # what a slot records
    best = np.full(texts * slots, np.iinfo(np.uint64).max, _U)
    until = np.where(total > 0, slots * (np.log(slots) + 3) / np.maximum(total, 1), 0.0)
    live = np.arange(len(who))
    t, k = np.zeros(len(who)), np.zeros(len(who), _U)
    while live.size:
        active = live
        while active.size:
            with np.errstate(over="ignore"):
                r = mixed(seed[active] + (k[active] + _U(1)) * _U(0xD1342543DE82EF95))
                r2 = mixed(r + _U(1))
            t_next = t[active] - np.log1p(-(r >> _U(11)).astype(float) * 2.0**-53) / rate[active]
            ok = t_next <= until[d[active]]
            active, r2, t_next = active[ok], r2[ok], t_next[ok]
            t[active] = t_next
            k[active] += _U(1)
            height = base[active] + ((r2 >> _U(40)).astype(float) * 2.0**-24 * rate[active]).astype(np.int64)
            hit = height < w[active]
            a = active[hit]
            slot = ((r2[hit] & _U(0xFFFFFFFF)) * _U(slots)) >> _U(32)
            early = (t_next[hit].astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | keep[a]
            np.minimum.at(best, d[a] * slots + slot.astype(np.int64), early)
        open_texts = (best.reshape(texts, slots) == np.iinfo(np.uint64).max).any(1) & (total > 0)
        until = np.where(open_texts, until * 2, until)
        live = live[open_texts[d[live]]]
    return (best & _U(0xFFFFFFFF)).reshape(texts, slots)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Band hashes of each text; null for a text without words."""
    data, offsets = text_bytes(batch.column("text"))
    texts = batch.num_rows
    doc, element, weight = shingle_counts(data, offsets)
    sig = bag_minhash(doc, element, weight, texts, BANDS * ROWS).reshape(texts, BANDS, ROWS)
    h = np.tile(np.arange(BANDS, dtype=_U), (texts, 1))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mixed(h * _U(_K) + sig[:, :, r])
    has = np.bincount(doc, minlength=texts) > 0
    flat = pa.array(h.view(np.int64).ravel())
    at = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
    flat = flat if has.all() else pa.array(h[has].view(np.int64).ravel())
    bands = pa.ListArray.from_arrays(pa.array(at), flat, mask=pa.array(~has))
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), bands], names=["id", "key", "bands"])


def bag_overlap(a: str, b: str, words: int = WORDS) -> float:
    """Weighted Jaccard similarity of two texts' word shingles."""
    one, two = (
        Counter([tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else [])
        for w in (a.encode().split(), b.encode().split())
    )
    if len(two) < len(one):
        one, two = two, one
    both = sum(min(n, two[k]) for k, n in one.items() if k in two)
    every = sum(one.values()) + sum(two.values()) - both
    return both / every if every else 0.0


def _verified(similarity: float):
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = (batch.column(c).to_pylist() for c in ("text_u", "text_v"))
        keep = pa.array([bag_overlap(a, b) >= similarity for a, b in zip(*cols, strict=True)], pa.bool_())
        return batch.select(["u", "v"]).filter(keep)

    return check


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts overlap enough. Hot ends are skewed join keys, which AQE splits."""
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v"
    )
    return staged(map_arrow(both, _verified(similarity), "u long, v long", "text_u"))


def _rare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The shingles of each text with their counts, and how many fall into each of CELLS cells."""
    texts = batch.num_rows
    doc, element, weight = shingle_counts(*text_bytes(batch.column("text")))
    cells = np.bincount(doc * CELLS + (element & _U(CELLS - 1)).astype(np.int64), weights=weight, minlength=texts * CELLS).astype(np.int32)
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (element.view(np.int64), weight)]
    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * CELLS), pa.array(cells)))
    return pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "shingles", "counts", "cells"])


def _shared_cells(texts: DataFrame) -> DataFrame:
    """Of each text: how many shingles it has, and by cell, how many of them occur in another of the texts too.

    What two texts have in common is at most the sum over cells of the smaller count.
    """
    lists = map_arrow(texts, _rare, "id long, shingles array<long>, counts array<long>, cells array<int>")
    each = lists.select("id", F.explode(F.arrays_zip("shingles", "counts")).alias("x")).select("id", "x.shingles", "x.counts")
    alone = each.groupBy("shingles").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("counts").alias("own")).where("n = 1")
    alone = alone.groupBy("id", F.col("shingles").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.sum("own").cast("int").alias("own"))
    alone = alone.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "own"))).alias("own"))
    shared = F.transform("cells", lambda c, i: c - F.coalesce(F.element_at("own", i), F.lit(0)))
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    both = lists.select("id", size.alias("size"), "cells").join(alone, "id", "left").select("id", "size", shared.alias("cells"))
    return both.withColumn("shared", F.aggregate("cells", F.lit(0), lambda x, y: x + y))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Group documents whose five-word shingle multisets have a weighted Jaccard similarity of 0.8 or more.

    Equal texts form a class, stood for by its smallest id. Signatures of all texts are banded.
    Within a bucket every class is compared with one head, the class that shares most buckets with
    others, so a group of n near copies gives n - 1 pairs. Where a bucket still holds several
    components after that, the documents outside the head's component are paired with the bucket's
    other components, so that no link found by banding is lost. A pair is left out there only if
    counts of the shingles that these documents share, by cells of a hash, rule the similarity
    out. Links are verified on the texts themselves.

    Returns one row per input row: id, group_id (the smallest id of its group), kept (whether the
    row has the group's smallest id and, of its texts, the first by digest) and key (the digest of
    its text). Texts that are null or without words link with nothing; null ids are kept, with a
    null group_id; rows that repeat an id with different texts are classes of their own, and fully
    repeated rows are all kept or none; ids may have any type that sorts.
    """
    spark = docs.sparkSession
    rows = ids_only(docs, id=doc_id, text=text)
    keyed = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    signed = staged(map_arrow(keyed, _signed, f"id {kind_of(rows, 'id')}, key binary, bands array<long>"))
    whole = signed.where("id is not null and bands is not null")
    first = staged(whole.groupBy("key").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    # classes are numbered in the order of their smallest ids, so a component's smallest number is that of its smallest id
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = first.repartitionByRange(parts, "id", "key").sortWithinPartitions("id", "key")
    classes = staged(ordered.withColumn("rep", F.monotonically_increasing_id()))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    sizes = staged(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = staged(banded.join(sizes, "band"))
    partners = staged(crowded.groupBy("rep").agg(F.sum("n").alias("partners")))
    heads = staged(
        crowded.join(partners, "rep").groupBy("band").agg(F.max_by("rep", F.struct("partners", -F.col("rep"))).alias("head"))
    )
    members = staged(crowded.select("band", "rep").join(heads, "band"))
    stars = staged(
        members.where("rep <> head").select(F.least("rep", "head").alias("u"), F.greatest("rep", "head").alias("v")).distinct()
    )
    needed = classes.select("rep", "key").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = staged(keyed.select("key", "text").join(needed, "key").dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "text"))
    links = _linked(stars, texts, similarity)
    of = staged(connected(links))
    # buckets in which the star left several components
    label = of.select(F.col("node").alias("rep"), "component")
    named = staged(members.join(label, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("c"), "head"))
    several = staged(named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band"))
    first = staged(named.where("rep = head").select("band", F.col("c").alias("c0")))
    split = staged(named.join(several, "band", "left_semi").join(first, "band"))
    apart = staged(split.select(F.col("rep").alias("id")).distinct())
    shared = staged(_shared_cells(texts.join(apart, "id", "left_semi")))
    # overlap <= shared and overlap <= size of the other, so these can't reach the similarity with any text
    split = staged(
        split.join(shared.withColumnRenamed("id", "rep"), "rep").where(F.col("shared") >= F.col("size") * similarity)
        .join(classes.select("rep", F.col("bands").alias("all")), "rep").drop("head")
    )
    out = split.where("c <> c0").select("band", F.col("rep").alias("u"), F.col("c").alias("cu"), F.col("size").alias("su"), F.col("shared").alias("hu"), F.col("cells").alias("xu"), F.col("all").alias("bu"))
    rest = split.select("band", F.col("rep").alias("v"), F.col("c").alias("cv"), "c0", F.col("size").alias("sv"), F.col("shared").alias("hv"), F.col("cells").alias("xv"), F.col("all").alias("bv"))
    enough = (F.col("su") + F.col("sv")) * (similarity / (1 + similarity)) - 1e-6  # that two texts must have in common
    common = F.aggregate(F.zip_with("xu", "xv", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    bound = (F.least("hu", "hv") >= enough) & (common >= enough)
    once = F.col("band") == F.array_min(F.array_intersect("bu", "bv"))  # in the first bucket that holds both
    more = staged(
        out.join(rest.withColumnRenamed("band", "b2"), (F.col("band") == F.col("b2")) & F.expr("cu <> cv and (u < v or cv = c0)") & bound & once)
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(stars, ["u", "v"], "left_anti")
    )
    if not more.isEmpty():
        links = links.unionByName(_linked(more, texts, similarity))
        of = staged(connected(links))
    of = classes.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("head"))
    heads = classes.select(F.col("rep").alias("head"), F.col("id").alias("group_id"), F.col("key").alias("head_key"))
    grouped = signed.select("id", "key", (F.col("bands").isNotNull() & F.col("id").isNotNull()).alias("grouped"))
    grouped = grouped.join(of.join(heads, "head").drop("head"), "key", "left").withColumn("group_id", F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("id")))
    first_of = (F.col("id") == F.col("group_id")) & (F.col("key") == F.col("head_key"))
    return grouped.select("id", "group_id", (~F.col("grouped") | first_of).alias("kept"), "key")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "group_id", "kept")
