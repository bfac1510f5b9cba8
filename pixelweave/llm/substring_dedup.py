"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import dropped, fresh, ids_only, kind_of, map_arrow, mixed, shuffles_removed, staged, table, text_bytes, with_arrow

BITS, SHORTEST, LONGEST = 5, 24, 256  # a cut about every 32 bytes, but 24 to 256 bytes apart
MIN_RUN = 100  # bytes of adjacent repeated chunks, and of equal text beside them, that make a repeated passage
GEAR = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at each byte: h = (h << 1) + gear[byte] on 32 bits, by doubling."""
    h = GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: np.ndarray, hashes: np.ndarray, bits: int, shortest: int, longest: int) -> list[int]:
    """Ends of the chunks of one text; the last is its length. Cuts keep UTF-8 characters whole."""
    n = len(data)
    top = np.uint32(((1 << bits) - 1) << (32 - bits))
    at = np.flatnonzero((hashes & top) == 0) + 1
    at = at[at < n]
    out, last = [], 0
    for c in [*at.tolist(), n]:
        if c - last < shortest and c < n:
            continue
        while c - last > longest:
            last += longest
            while last < n and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        while c < n and data[c] & 0xC0 == 0x80:
            c += 1
        if c > last:
            out.append(c)
            last = c
    return out


def _chunker(bits: int, shortest: int, longest: int):
    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column("text"))
        digests, ends, counts = [], [], []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = data[s:e]
            at = cuts(own, gear_hashes(own), bits, shortest, longest) if e > s else []
            view, last = own.tobytes(), 0
            for c in at:
                digests.append(xxhash.xxh3_128_digest(view[last:c]))
                last = c
            ends += at
            counts.append(len(at))
        at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        d = pa.ListArray.from_arrays(at, pa.array(digests, pa.binary()))
        e = pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc"), d, e], names=["doc", "digests", "ends"])

    return chunk


def _runs(ends: list[int], seen: list[dict]) -> list[tuple[int, int, dict, dict]]:
    """Runs of adjacent repeated chunks: start, end, and the first and the last chunk."""
    runs: list[tuple[int, int, dict, dict]] = []
    for x in sorted({x["at"]: x for x in seen}.values(), key=lambda x: x["at"]):
        s, e = ends[x["at"] - 1] if x["at"] else 0, ends[x["at"]]
        if runs and runs[-1][1] == s:
            runs[-1] = (runs[-1][0], e, runs[-1][2], x)
        else:
            runs.append((s, e, x, x))
    return runs


def _edges(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Both sides of every run, with the document that keeps its chunk there and the bytes as far as the next run."""
    out = []
    for i, ends, seen in zip(*(batch.column(c).to_pylist() for c in ("doc", "ends", "seen")), strict=True):
        runs = _runs(ends, seen)
        for k, (s, e, first, last) in enumerate(runs):
            before = s - (runs[k - 1][1] if k else 0)
            after = (runs[k + 1][0] if k + 1 < len(runs) else ends[-1]) - e
            out += [(i, k, left, x["first"], x["digest"], n) for left, x, n in ((True, first, before), (False, last, after)) if n]
    doc = batch.column("doc").type
    kinds = [doc, pa.int32(), pa.bool_(), doc, pa.binary(), pa.int32()]
    cols = zip(*out, strict=True) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "run", "left", "keeper", "digest", "n"])


def _same(a: bytes, b: bytes) -> int:
    """The bytes that two texts have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def _cutter(text: str, marks: list[str], min_run: int):
    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        cols = (batch.column(c).to_pylist() for c in (text, *marks))
        for body, ends, seen, beside in zip(*cols, strict=True):
            raw = (body or "").encode()
            reach: dict[tuple[int, bool], int] = {}
            runs = _runs(ends, seen) if seen else []
            for x in beside or ():
                s, e = runs[x["run"]][:2]
                n = _same(raw[:s][-len(x["near"]) :][::-1], x["near"][::-1]) if x["left"] else _same(raw[e : e + len(x["near"])], x["near"])
                reach[x["run"], x["left"]] = max(reach.get((x["run"], x["left"]), 0), n)
            spans: list[list[int]] = []
            for k, (s, e, _, _) in enumerate(runs):
                from_, to = s - reach.get((k, True), 0), e + reach.get((k, False), 0)
                while from_ < s and raw[from_] & 0xC0 == 0x80:
                    from_ += 1
                while to > e and to < len(raw) and raw[to] & 0xC0 == 0x80:
                    to -= 1
                if spans and spans[-1][1] >= from_:
                    spans[-1][1] = max(spans[-1][1], to)
                else:
                    spans.append([from_, to])
            spans = [(s, e) for s, e in spans if e - s >= min_run]
            kept, last = [], 0
            for s, e in spans:
                kept.append(raw[last:s])
                last = e
            left = b"".join([*kept, raw[last:]])
            out.append((len(raw), len(raw) - len(left), len(spans), left.decode() if spans else body))
        kinds = [pa.int64()] * 3 + [pa.string()]
        return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]

    return cut


def repeated_chunks(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, shortest: int = SHORTEST,
    longest: int = LONGEST, min_run: int = MIN_RUN,
) -> DataFrame:
    """Remove passages whose chunks also occur in a document with a smaller id.

    A gear rolling hash cuts each text where its content says so; an insertion therefore shifts
    only the cuts near it. Chunks are told apart by a 128-bit digest. The smallest id that holds
    a digest keeps its chunk; in every other document a run of adjacent chunks kept elsewhere is
    extended on both sides, byte by byte, as far as it equals the text that keeps its outer chunk,
    and removed if it then spans at least `min_run` bytes. Repeats within one document stay.

    Returns every row with its columns and n_bytes, n_removed, n_spans and text_left (what is left;
    null stays null); columns of these names are replaced. Digests are pre-aggregated before their
    shuffle; where occurrences meet the digests that stay, a digest that most documents hold is a
    skewed join key, which AQE splits. Rows with a null id are neither source nor target and are
    returned whole. Rows that repeat an id with different texts are told apart by their text, and
    don't count as copies of each other; fully repeated rows get the same answer. Empty texts have
    no chunks. Ids may have any type that sorts.
    """
    rows = ids_only(docs, id=doc_id, text=text).withColumn("doc", F.struct("id", F.xxhash64("text").alias("h"))).where("id is not null")
    doc = f"doc struct<id: {kind_of(rows, 'id')}, h: bigint>"
    spark = docs.sparkSession
    chunks = staged(map_arrow(rows.select("doc", "text"), _chunker(bits, shortest, longest), f"{doc}, digests array<binary>, ends array<int>"))
    single = chunks.select("doc", F.posexplode("digests").alias("at", "digest"))
    kept = single.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc.id").alias("last"))
    with shuffles_removed(spark):
        kept = staged(kept.where("first.id < last").select("digest", "first"))
    seen = single.join(kept, "digest").where("doc.id > first.id").groupBy("doc").agg(F.collect_list(F.struct("at", "first", "digest")).alias("seen"))
    once = chunks.dropDuplicates(["doc"])
    with shuffles_removed(spark):
        marks = staged(once.join(seen, "doc").select("doc", "ends", "seen"))
    dropped(kept)
    kind = f"{doc}, run int, left boolean, keeper {doc[4:]}, digest binary, n int"
    edges = marks.mapInArrow(lambda batches: map(_edges, batches), kind)
    keepers = once.select(F.col("doc").alias("keeper"), "digests", F.col("ends").alias("kept_ends"))
    place = F.array_position("digests", F.col("digest")).cast("int")
    edges = edges.join(keepers, "keeper").select(
        "doc", "run", "left", "keeper", "n",
        F.coalesce(F.get("kept_ends", place - F.when(F.col("left"), 2).otherwise(1)), F.lit(0)).alias("edge"),
    )
    texts = rows.select(F.col("doc").alias("keeper"), F.col("text").cast("binary").alias("whole"))
    start = F.when(F.col("left"), F.greatest(F.col("edge") - F.col("n"), F.lit(0))).otherwise(F.col("edge"))
    length = F.when(F.col("left"), F.least("n", "edge")).otherwise(F.col("n"))
    near = F.substring(F.col("whole"), start + 1, length).alias("near")
    beside = edges.join(texts, "keeper").select("doc", "run", "left", near).where("length(near) > 0")
    with shuffles_removed(spark):
        beside = staged(beside.groupBy("doc").agg(F.collect_list(F.struct("run", "left", "near")).alias("beside")))
    dropped(chunks)
    own, *names = fresh(docs, "_doc", "_ends", "_seen", "_beside")
    marks = marks.join(beside, "doc", "left").select(*(F.col(c).alias(n) for c, n in zip(("doc", "ends", "seen", "beside"), (own, *names), strict=True)))
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"))
    joined = docs.withColumn(own, key).join(marks, own, "left").drop(own)
    added = "n_bytes long, n_removed long, n_spans long, text_left string"
    return with_arrow(joined, _cutter(text, names, min_run), added, text).drop(*names)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk deduplication leaves of every document."""
    return repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans",
        F.sha2(F.coalesce("text_left", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
