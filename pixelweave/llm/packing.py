"""Packing tokenized documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, staged, table

WINDOW = 2048
END_ID = 1  # closes each document
GROUP = 1500  # pieces that are packed together: bounds a task, and its part-filled windows


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str | None):
    """Texts to ids. The ranks file holds the same vocabulary for a faster encoder, used for
    Latin text; whatever it can't take goes to the tokenizers library."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    special = {"<|endoftext|>": len(ranks)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if text.isascii() or max(text) < "ɐ":
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a panic of its regex engine on extreme runs; its class can't be imported
                if type(e).__name__ != "PanicException":
                    raise
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _pieces(json_path: str, ranks_path: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = _encoder(json_path, ranks_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), window):
                    own = ids[s : s + window]
                    out.append((i, s, len(own), zlib.crc32(own.tobytes()), len(ids), uid))
                    uid += 1
            if out:
                row, *cols = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), *cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "uid"])

    return run


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window of each piece and its offset there.

    The leaves of a segment tree count the open windows by remaining capacity; the first filled
    leaf at or right of a piece's length is the tightest window that takes it.
    """
    size = 1 << window.bit_length()
    tree, stacks = [0] * (2 * size), [[] for _ in range(window + 1)]

    def change(leaf: int, by: int) -> None:
        leaf += size
        while leaf:
            tree[leaf] += by
            leaf >>= 1

    def tightest(need: int) -> int:
        node = need + size
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    into, offset, opened = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tightest(need)
        if room < 0:
            room, at = window, opened
            opened += 1
        else:
            at = stacks[room].pop()
            change(room, -1)
        into[i], offset[i] = at, window - room
        if room > need:
            stacks[room - need].append(at)
            change(room - need, 1)
    return into, offset


def packed(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", json_path: str | None = None, ranks_path: str | None = None,
    window: int = WINDOW, end_id: int = END_ID, group: int = GROUP,
) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens.

    A document's ids are those of its text and `end_id`. It is cut into full windows, each a
    sequence of its own, and a rest. The rests are dealt at random into groups of about `group`
    pieces, and each group is packed by best-fit decreasing; the number of groups follows the
    input, so a task stays bounded.

    Returns one row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id (unique, not
    gapless) and offset. Null and empty texts are one piece, the end id; null ids and repeated
    rows are packed like any other row.
    """
    import public_tokenizers

    if json_path is None:
        json_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = ids_only(docs, id=doc_id, text=text)
    schema = f"id {dict(rows.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, uid long"
    pieces = staged(rows.mapInArrow(_pieces(json_path, ranks_path, window, end_id), schema))
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        into, offset = best_fit_decreasing(part["length"].tolist(), window)
        part["sequence_id"] = 2 * (part["g"] + groups * np.asarray(into, np.int64))
        part["offset"] = np.asarray(offset, np.int64)
        return part.drop(columns="g")

    dealt = rest.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    fitted = dealt.groupBy("g").applyInPandas(fit, f"{schema}, sequence_id long, offset long")
    return full.unionByName(fitted).drop("uid")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
