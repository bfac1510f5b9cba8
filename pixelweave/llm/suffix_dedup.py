"""Exact removal of repeated byte strings by distributed difference-cover suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import dropped, ids_only, large_rows, mixed, shuffles_removed, staged, table, text_bytes

SPAN = 50  # bytes of a repeated string
TRIPLE = 24  # bytes of the shortest key of the first level: three words of eight; where spans allow, the words have sixteen
BLOCK = 2_000_000  # bytes of text that ask the ranges together, about: every block asks every range, so small blocks and ranges make rows without end
SORTED = 500_000  # bytes of a block that are sorted at once, about; longer texts are cut into overlapping pieces
PART = 1_200_000  # keys of a range, about
PICKED = 20  # keys a range that its bounds are chosen from, as many as a range shuffle of Spark's would sample
EVERY = 17  # one of so many keys is looked at for the bounds; odd, so that both classes of a cover come in
DENSITY = 2.2  # fingerprints are chosen at a rate of about 2 / (SPAN - TRIPLE + 2) of all positions
TILE = 1 << 15  # positions that are fingerprinted at once: their numbers stay in a core's cache
_NAME_BITS = 46
_U = np.uint64


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them; zeros beyond the end."""
    n = len(data)
    padded = np.append(data, np.zeros(16 + -n % 8, np.uint8))
    out = np.empty(n + -n % 8, _U)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(">u8")
    return out[:n]


def packed(data: bytes) -> bytes:
    """Shrunk before Spark copies, shuffles and writes it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers, their first bytes first, then their second ones: sorted or small ones shrink well."""
    return packed(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(8, -1).T).view(kind).ravel() if data else np.empty(0, kind)


def ranks(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number occurs, in their order, and for each number its place among them.

    A number that leaves room for its position is sorted together with it, which is faster than sorting positions.
    """
    n = len(code)
    width = _U(max(1, n.bit_length()))
    if int(code.max(initial=0)) >> (64 - int(width)):
        order = np.argsort(code)
        s = code[order]
    else:
        s = (code << width) | np.arange(n, dtype=_U)
        s.sort()
        order = (s & ((_U(1) << width) - _U(1))).view(np.int64)
        s >>= width
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], place


class Block:
    """Pieces of texts side by side; no string crosses from one into the next."""

    def __init__(self, ends: bytes, data: bytes):
        self.data, self.ends = np.frombuffer(data, np.uint8), np.frombuffer(ends, np.int64).astype(np.int32)
        self.starts = np.append(0, self.ends[:-1]).astype(np.int32)
        self.piece = np.repeat(np.arange(len(self.ends), dtype=np.int32), self.ends - self.starts)
        every = np.arange(len(self.data), dtype=np.int32)
        self.at = every - self.starts[self.piece]
        self.left = self.ends[self.piece] - every  # bytes to the end of the piece

    def prints(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where strings of `span` bytes start, and a fingerprint for each of these strings.

        It is the smallest hash of the TRIPLE-byte strings inside, so equal strings have equal
        fingerprints, and neighbouring strings mostly share theirs.
        """
        n, most = len(self.data), span - TRIPLE + 1
        padded = np.append(self.data, np.zeros(span, np.uint8))
        out = np.empty(n, _U)
        for s in range(0, n, TILE):
            m = min(TILE, n - s) + most - 1
            w = eight(padded[s : s + m + TRIPLE - 1])
            with np.errstate(over="ignore"):
                h = mixed(w[:m] * _U(0xD1342543DE82EF95) + w[8 : m + 8] * _U(0x9E3779B97F4A7C15) + w[16 : m + 16] * _U(0xBF58476D1CE4E5B9))
            width = 1
            while 2 * width <= most:
                h[:-width] = np.minimum(h[:-width], h[width:])
                width *= 2
            if most > width:
                h[: width - most] = np.minimum(h[: width - most], h[most - width :])
            out[s : s + TILE] = h[: min(TILE, n - s)]
        i = np.flatnonzero(self.left >= span)
        return i, out[i]

    def sampled(self, depth: int) -> np.ndarray:
        """Positions of the difference cover {1, 2} modulo 3 with so many bytes after them."""
        return np.flatnonzero((self.at % 3 != 0) & (self.left >= depth))

    def rows(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The strings of so many bytes at these positions."""
        return np.lib.stride_tricks.sliding_window_view(np.append(self.data, np.zeros(depth, np.uint8)), depth)[at].view(f"S{depth}").ravel()

    def triples(self, depth: int, text: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Distinct strings of `depth` bytes at the cover's positions, sorted (if asked for), each position's place among them, and the positions.

        Ranks of six bytes make those of twelve, and so on: six and its doubles keep to the cover, as they divide by three.
        """
        n, cover = len(self.data), np.flatnonzero(self.at % 3 != 0)
        letters = np.zeros(256, bool)
        letters[self.data] = True
        letters = np.cumsum(letters).astype(_U)
        bits = _U(int(letters[-1]).bit_length())
        coded, known, long = np.append(letters[self.data], np.zeros(6, _U)), np.zeros(n + depth, _U), 6
        code = coded[cover]
        for k in range(1, long):
            code = code << bits | coded[cover + k]
        while True:
            _, place = ranks(code)
            known[cover] = place
            bits = _U(int(place.max(initial=0)).bit_length())
            if 2 * long == depth:
                break
            code = known[cover] << bits | known[cover + long]
            long *= 2
        i = self.sampled(depth)
        one, place = ranks(known[i] << bits | known[i + long])
        return self.rows(i[one], depth) if text else None, place, i

    def doubled(self, names: np.ndarray, depth: int, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Keys of twice the depth: two adjacent names. Where a name is 0, no string repeats."""
        i = self.sampled(2 * depth)[::every]
        keys = np.stack([names[i], names[i + depth]], axis=1)
        known = (keys > 0).all(axis=1)
        return keys[known], i[known]

    def merged(self, names: np.ndarray, depth: int, span: int, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Keys of `span` bytes at every position, and the positions. Two suffixes, whatever their
        places modulo 3, meet in one of three ways in which both go on with named suffixes: after no
        byte, after one or after two. The last name ends at most two bytes before the key does."""
        n = len(self.data)
        t, named = np.append(self.data, [0, 0]).astype(_U), np.append(names, np.zeros(2, _U))
        ok, m = self.left >= span, self.at % 3
        out, where = [], []
        for way, skip in ((0, 0), (1, 2), (2, 1)):  # positions of the other two classes, bytes before the named suffix
            i = np.flatnonzero(ok & (m != way))[::every]
            second = (span - skip - depth) // 3 * 3
            i = i[(named[i + skip] > 0) & (named[i + skip + second] > 0)]
            over = [*range(skip), *range(skip + second + depth, span)]  # at most two before, two after
            loose = np.zeros(len(i), _U)
            for k in over:
                loose = loose << _U(8) | t[np.minimum(i + k, n)]
            head = (_U(way) << _U(62)) | (named[i + skip] << _U(16))
            keys = [head | (loose & _U(0xFFFF))]
            if span - depth > 2:  # else one name and two bytes are all
                keys.append(named[i + skip + second] << _U(16) | loose >> _U(16))
            out.append(np.stack(keys, axis=1))
            where.append(i)
        return np.concatenate(out), np.concatenate(where)


def unique_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows, and for each row its place among them. Columns are ranked one by one, and their ranks joined."""
    distinct, place = np.unique(keys[:, 0], return_inverse=True)
    if keys.shape[1] == 1:
        return distinct[:, None], place
    code, many = place, len(distinct)
    for column in keys.T[1:]:
        distinct, place = np.unique(column, return_inverse=True)
        if many * len(distinct) >= 1 << 62:
            ranks, code = np.unique(code, return_inverse=True)
            many = len(ranks)
        code, many = code * len(distinct) + place, many * len(distinct)
    codes, place = np.unique(code, return_inverse=True)
    one = np.empty(len(codes), np.int64)
    one[place] = np.arange(len(place))
    return keys[one], place


def unique_by_way(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """unique_rows of merge keys, which come way by way."""
    if keys.shape[1] > 1:
        return unique_rows(keys)
    x, found, places, many = keys[:, 0], [], [], 0
    edge = np.searchsorted(x >> _U(62), np.arange(4, dtype=_U))
    for s, e in zip([*edge.tolist()], [*edge.tolist()[1:], len(x)], strict=True):
        one, place = ranks(x[s:e] & _U((1 << 62) - 1))
        found.append(x[s:e][one])
        places.append(place + np.int32(many))
        many += len(one)
    return np.concatenate(found)[:, None], np.concatenate(places)


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like them."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel()


def _coded(keys: np.ndarray) -> bytes:
    """Sorted byte strings for their way: of names by columns, of text by rows, in which neighbours begin alike."""
    width = keys.itemsize // 8
    return planes(keys.view(">u8").reshape(-1, width).T.astype(_U)) if width < 3 else packed(keys.tobytes())


def _places(parts: list[bytes], width: int) -> tuple[list[int], int, np.ndarray]:
    """Of coded keys: how many each part has, how many are distinct, and each one's place among these."""
    lengths = [int.from_bytes(k[:8], "little") // (8 * width) for k in parts]
    if width == 1:
        keys = np.concatenate([unplaned(k, _U) for k in parts])
        one, place = ranks(keys - keys.min(initial=np.iinfo(_U).max))  # a range's keys lie close together
        return lengths, len(one), place
    if width == 2:
        distinct, place = unique_rows(np.concatenate([unplaned(k, _U).reshape(2, -1).T for k in parts]))
        return lengths, len(distinct), place
    n, s = sum(lengths), 0
    keys = np.empty(n, f"S{8 * width}")
    for k, many in zip(parts, lengths, strict=True):
        keys[s : s + many] = np.frombuffer(unpacked(k), keys.dtype)
        s += many
    order = np.argsort(keys, kind="stable")  # merges the lists, which are sorted
    new = np.ones(n, bool)
    for s in range(1, n, 1 << 16):
        e = min(n, s + (1 << 16))
        run = keys[order[s - 1 : e]]
        new[s:e] = run[1:] != run[:-1]
    del keys
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return lengths, int(new.sum()), place


def _row(schema: list[tuple[str, pa.DataType]], *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip(cells, schema, strict=True)], names=[n for n, _ in schema])


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a block as one batch, if there are any."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])


_TEXTS = [("block", pa.int64()), ("keys", pa.binary()), ("offsets", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())]
_TEXTS_DDL = "block long, keys binary, offsets binary, ends binary, data binary"
_PARTS = [("block", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary()), ("offsets", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("names", pa.binary())]
_PRINTS = [("block", pa.int64()), ("part", pa.int64()), ("prints", pa.binary()), ("tags", pa.binary())]
_ASKS = [("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("keys", pa.binary()), ("holders", pa.binary()), ("several", pa.binary())]
_PARTS_DDL = "block long, ids binary, keys binary, offsets binary, ends binary, data binary, names binary"


def _text_blocks(span: int):
    """Distinct texts of a partition side by side, in pieces that overlap by span - 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece = TaskContext.get().partitionId() << 24, min(BLOCK, SORTED)
        keys, offsets, parts, size = {}, [], [], 0

        def whole() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
            return _row(_TEXTS, number, b"".join(k for k, n in keys.items() for _ in range(n)), np.array(offsets, np.int64).tobytes(), ends.tobytes(), b"".join(parts))

        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for key, s, e in zip(batch.column("key").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if key in keys:
                    continue
                for first in range(s, max(s + 1, e - span + 1), piece):
                    if size >= BLOCK:
                        yield whole()
                        number += 1
                        keys, offsets, parts, size = {}, [], [], 0
                    parts.append(data[first : min(e, first + piece + span - 1)].tobytes())
                    keys[key] = keys.get(key, 0) + 1
                    offsets.append(first - s)
                    size += len(parts[-1])
        if keys:
            yield whole()

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(c)[r].as_py() for c in batch.schema.names}


def _runs(row: dict) -> Iterator[tuple[int, int, Block]]:
    """The pieces of a block, about SORTED bytes of them at a time: the number of the first, where it starts, and what is sorted at once."""
    ends = np.frombuffer(row["ends"], np.int64)
    starts = np.append(0, ends[:-1])
    edge = np.flatnonzero(np.append(True, np.diff(starts // SORTED) > 0)).tolist()
    for a, b in zip(edge, [*edge[1:], len(ends)], strict=True):
        s, e = int(starts[a]), int(ends[b - 1])
        yield a, s, Block((ends[a:b] - s).tobytes(), row["data"][s:e])


def _distinct_prints(row: dict, span: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one fingerprint: their pieces, their first and last positions, and the place of each one's
    fingerprint among the sorted distinct ones; these, and the tag of their text. The lowest bit of a tag says that
    several texts of the block have the fingerprint."""
    found = []
    for a, s, block in _runs(row):
        at, prints = block.prints(span)
        first = np.flatnonzero(np.append(True, (prints[1:] != prints[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
        found.append((block.piece[at[first]] + a, at[first] + s, at[np.append(first[1:], len(at)) - 1][: len(first)] + s, mixed(prints[first])))  # smallest hashes are small: mixed, they fill all ranges alike
    piece, begin, end, prints = (np.concatenate(x) for x in zip(*found, strict=True))
    tags = np.frombuffer(row["keys"], _U)[::2] & ~_U(1)
    distinct, one, place = np.unique(prints, return_index=True, return_inverse=True)
    own = tags[piece]
    tag = own[one]
    several = np.zeros(len(distinct), bool)
    several[place[own != tag[place]]] = True
    return piece, begin, end, place, distinct, tag | several.astype(_U)


def _candidates(texts: DataFrame, parts: int, span: int) -> DataFrame:
    """Stretches of text in which every string's fingerprint occurs in another text too: (key, offset, data, print).

    Strings that repeat lie in such stretches whole, since equal strings have equal fingerprints.
    Rows of the shuffle hold the fingerprints of one block and one range of fingerprints.
    """

    def asks(batches):
        for row in _each(batches):
            *_, prints, tags = _distinct_prints(row, span)
            edge = np.searchsorted(_range_of_print(prints, parts), np.arange(parts + 1))
            cuts = [(p, slice(edge[p], edge[p + 1])) for p in np.flatnonzero(np.diff(edge)).tolist()]
            yield from _rows(_PRINTS, [(row["block"], p, prints[cut].tobytes(), tags[cut].tobytes()) for p, cut in cuts])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        prints, tags = (np.concatenate([np.frombuffer(x, _U) for x in part[c]]) for c in ("prints", "tags"))
        order = np.argsort(prints, kind="stable")
        p, t = prints[order], tags[order]
        new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        several = (np.maximum.reduceat(t & _U(1), new) > 0) | (np.minimum.reduceat(t | _U(1), new) != np.maximum.reduceat(t | _U(1), new))
        shared = np.empty(len(p), bool)
        shared[order] = np.repeat(several, np.diff(np.append(new, len(p))))
        out = part[["block", "part"]].copy()
        out["bits"] = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(x) // 8 for x in part["prints"]])[:-1])]
        return out

    def stretches(batches):
        for row in _each(batches):
            piece, begin, end, place, prints, _ = _distinct_prints(row, span)
            edge = np.searchsorted(_range_of_print(prints, parts), np.arange(parts + 1))
            shared = np.zeros(len(prints), bool)
            for a in row["answers"] or ():
                s, e = edge[a["part"]], edge[a["part"] + 1]
                shared[s:e] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=e - s).astype(bool)
            ok = shared[place]
            i, j, k, p = begin[ok], end[ok], piece[ok], prints[place[ok]]
            if not len(i):
                continue
            first = np.flatnonzero(np.append(True, (i[1:] - j[:-1] > span) | (k[1:] != k[:-1])))
            lows, lasts = np.minimum.reduceat(p, first), j[np.append(first[1:], len(i)) - 1]
            i, k, keys = i[first], k[first], row["keys"]
            offsets = np.frombuffer(row["offsets"], np.int64)[k] + i - np.append(0, np.frombuffer(row["ends"], np.int64)[:-1])[k]
            out = []
            for k, offset, s, e, low in zip(k.tolist(), offsets.tolist(), i.tolist(), lasts.tolist(), lows.tolist(), strict=True):
                out.append((keys[16 * k : 16 * k + 16], offset, row["data"][s : e + span], low))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64())
            cols = [*zip(*out, strict=True)]
            cols[3] = np.array(cols[3], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "offset", "data", "print"])

    found = texts.mapInArrow(asks, "block long, part long, prints binary, tags binary")
    bits = staged(found.groupBy("part").applyInPandas(answer, "block long, part long, bits binary"))
    lists = bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    out = staged(texts.join(lists, "block", "left").mapInArrow(stretches, "key binary, offset long, data binary, print long"))
    dropped(bits)
    return out


def _range_of_print(prints: np.ndarray, parts: int) -> np.ndarray:
    """Fingerprints are hashes: equal ranges hold about equally many."""
    return (prints >> _U(32)) * _U(parts) >> _U(32)


def _stretch_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, rows, size = TaskContext.get().partitionId() << 24, [], 0

    def whole() -> pa.RecordBatch:
        ids, keys, offsets, data = zip(*rows, strict=True)
        ends = np.cumsum([len(x) for x in data]).astype(np.int64)
        return _row(_PARTS, number, np.array(ids, np.int64).tobytes(), b"".join(keys), np.array(offsets, np.int64).tobytes(), ends.tobytes(), b"".join(data), b"")

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("rank", "key", "offset", "data")), strict=True):
            rows.append(row)
            size += len(row[3])
            if size >= BLOCK:
                yield whole()
                number, rows, size = number + 1, [], 0
    if rows:
        yield whole()


def _answered(blocks: DataFrame, sampled, keys_of, width: int, *, span: int = 0) -> DataFrame:
    """Send every block's distinct keys to ranges of keys, and bring back a number for each position.

    The number is the key's rank in the whole input from 1 on (its name), or 0 if one document
    alone holds the key. At the last level, where `span` is given, it is 1 if a smaller document
    holds the key than any of this block, and the result is what these positions remove. A key that
    many texts hold is sent once a block, and a block sends a row only to ranges in which it has
    keys; what a block sorts at once is one list of the row. `sampled` gives one of every so many keys of
    such a list, `keys_of` its sorted distinct keys, each position's place among them, and the positions.
    """
    spark, last = blocks.sparkSession, span > 0

    def sorted_at_once(row):
        names = unplaned(row["names"], _U)
        for a, s, block in _runs(row):
            yield a, s, block, names[s : s + len(block.data)]

    def sample(batches):
        for row in _each(batches):
            n, pick = 0, []
            for _, _, block, names in sorted_at_once(row):
                keys = sampled(block, names, EVERY)
                n += EVERY * len(keys)
                pick.append(keys[np.linspace(0, len(keys) - 1, min(-(-PICKED * EVERY * len(keys) // PART), len(keys))).astype(int)].tobytes())
            yield _row([("n", pa.int64()), ("keys", pa.binary())], n, b"".join(pick))

    got = blocks.mapInArrow(sample, "n long, keys binary").collect()  # about PICKED keys a range, at least one a block
    parts = max(1, -(-sum(r["n"] for r in got) // PART))
    pool = np.sort(np.concatenate([np.empty(0, f"S{8 * width}"), *(np.frombuffer(bytes(r["keys"]), f"S{8 * width}") for r in got if r["keys"])]))
    bounds = pool[np.linspace(0, len(pool), parts + 1)[1:-1].astype(int)]
    far = np.iinfo(np.int64).max

    def requests(batches):
        for row in _each(batches):
            lists, edges = [], []
            for a, _, block, names in sorted_at_once(row):
                distinct, place, where = keys_of(block, names)
                own = np.frombuffer(row["ids"], np.int64)[block.piece[where] + a]
                low, high = np.full(len(distinct), far), np.full(len(distinct), -far)
                np.minimum.at(low, place, own)
                np.maximum.at(high, place, own)
                lists.append((distinct, low, low != high))
                edges.append(np.concatenate([[0], np.searchsorted(distinct, bounds, "right"), [len(distinct)]]).astype(np.int64))
            counts, out, size = np.diff(np.array(edges), axis=1), [], 0
            for p in np.flatnonzero(counts.any(axis=0)).tolist():
                keys, low, several = (np.concatenate([x[e[p] : e[p + 1]] for x, e in zip(c, edges, strict=True)]) for c in zip(*lists, strict=True))
                out.append((row["block"], p, counts[:, p].tobytes(), _coded(keys), planes(low), b"" if last else np.packbits(several).tobytes()))
                size += len(out[-1][3])
                if size > 1 << 22:
                    yield from _rows(_ASKS, out)
                    out, size = [], 0
            yield from _rows(_ASKS, out)

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        lengths, many, place = _places(part["keys"], width)  # adjacent equal keys are one
        holders = np.concatenate([unplaned(x, np.int64) for x in part["holders"]])
        low = np.full(many, far)
        np.minimum.at(low, place, holders)
        if last:
            numbers = holders > low[place]
        else:
            high = np.full(many, -far)
            np.maximum.at(high, place, holders)
            several = low != high
            np.logical_or.at(several, place, np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part["several"], lengths, strict=True)]).astype(bool))
            names = np.where(several, np.cumsum(several), 0)
            numbers = names[place]
        out = part[["block", "part", "counts"]].copy()
        cut = np.split(numbers, np.cumsum(lengths)[:-1])
        out["numbers"] = [np.packbits(x).tobytes() if last else planes(x.astype(np.int64)) for x in cut]
        out["size"] = 0 if last else int(names.max(initial=0))
        return out

    asked = blocks.mapInArrow(requests, "block long, part long, counts binary, keys binary, holders binary, several binary")
    answers = staged(asked.groupBy("part").applyInPandas(answer, "block long, part long, counts binary, numbers binary, size long"))
    # the names of a range start where those of the ranges before it end: one row a range
    sizes = {} if last else {r["part"]: r["size"] for r in answers.groupBy("part").agg(F.max("size").alias("size")).collect()}
    first = np.cumsum([0] + [sizes.get(p, 0) for p in range(parts)])
    if first[-1] >= 1 << _NAME_BITS:
        raise ValueError("too many names")
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "numbers")).alias("answers"))

    def numbered(answers: list) -> list[np.ndarray]:
        """The numbers of each list's keys, in their order."""
        found = []
        for a in sorted(answers, key=lambda a: a["part"]):
            counts = np.frombuffer(a["counts"], np.int64)
            if last:
                numbers = np.unpackbits(np.frombuffer(a["numbers"], np.uint8), count=counts.sum())
            else:
                numbers = unplaned(a["numbers"], np.int64)
                numbers = np.where(numbers > 0, numbers + first[a["part"]], 0)
            found.append(np.split(numbers, np.cumsum(counts)[:-1]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def joined(batches):
        for row in _each(batches):
            found, every = numbered(row["answers"] or ()), []
            for k, (a, _, block, names) in enumerate(sorted_at_once(row)):
                # sorted again: their places would take more disk than the keys
                _, place, where = keys_of(block, names, False)
                numbers = found[k] if found else np.empty(0, np.int64)
                if last:  # a smaller document may also lie in the block itself
                    own = np.frombuffer(row["ids"], np.int64)[block.piece[where] + a]
                    low = np.full(len(numbers), far)
                    np.minimum.at(low, place, own)
                    yield _gone(row, a, block, where[(numbers[place] > 0) | (low[place] < own)], span)
                else:
                    every.append(np.zeros(len(block.data), _U))
                    every[-1][where] = numbers[place].astype(_U)
            if not last:
                yield _row(_PARTS, *(row[c] for c, _ in _PARTS[:-1]), planes(np.concatenate(every)))

    out = staged(blocks.join(lists, "block", "left").mapInArrow(joined, "key binary, s long, e long" if last else _PARTS_DDL))
    dropped(answers)
    dropped(blocks)
    return out


def _gone(row: dict, piece: int, block: Block, again: np.ndarray, span: int) -> pa.RecordBatch:
    """The removed intervals of stretches from this one on, as places in their texts."""
    edge = np.zeros(len(block.data) + 1, np.int64)
    hit = np.zeros(len(block.data), bool)
    hit[again] = True
    again = np.flatnonzero(hit)
    edge[again] += 1
    edge[again + span] -= 1
    gone = np.append(np.cumsum(edge)[:-1] > 0, False)
    new = np.append(0, block.ends[:-1])
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1]
    begin[new] |= gone[new]
    end[:-1] &= ~gone[1:]
    end[block.ends - 1] |= gone[block.ends - 1]
    s, e = np.flatnonzero(begin[:-1]), np.flatnonzero(end[:-1]) + 1
    k = block.piece[s] + piece
    base = np.frombuffer(row["offsets"], np.int64)[k]
    cols = [
        pa.array([row["keys"][16 * i : 16 * i + 16] for i in k.tolist()], pa.binary()),
        pa.array(base + block.at[s]), pa.array(base + block.at[e - 1] + 1),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["key", "s", "e"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its removed intervals."""
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        out = []
        for spans, s, e in zip(batch.column("gone").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            kept, last, runs, removed = hashlib.sha256(), 0, 0, 0
            for x in sorted(spans, key=lambda x: x["s"]):  # those of neighbouring pieces may touch or overlap
                if x["s"] > last or not runs:
                    kept.update(data[s + last : s + x["s"]])
                    runs += 1
                removed += max(0, x["e"] - max(last, x["s"]))
                last = max(last, x["e"])
            kept.update(data[s + last : e])
            out.append((removed, runs, kept.hexdigest()))
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *cols], names=["key", "n_removed", "n_spans", "kept_sha256"])


def _keys(keys_of, unique):
    """Of keys that are rows of numbers: a sample, and distinct ones with places and positions, as byte strings."""

    def distinct(block: Block, names: np.ndarray, text: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        keys, where = keys_of(block, names)
        rows, place = unique(keys)
        return _sortable(rows) if text else None, place, where

    return lambda block, names, every: _sortable(keys_of(block, names, every)[0]), distinct


def _cuts(keyed: DataFrame, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with the key of their text; the smallest id of each key; and what is left of the texts that others repeat."""
    spark = keyed.sparkSession
    known = staged(
        keyed.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    )
    long = known.where(f"id is not null and n_bytes >= {span}")
    first = staged(long.groupBy("key").agg(F.min("id").alias("rep")))
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    texts = keyed.where(F.col("id").isNotNull() & (F.octet_length("text") >= span)).select("key", "text")
    blocks = staged(texts.mapInArrow(_text_blocks(span), _TEXTS_DDL))
    parts = max(1, int(total * DENSITY / (span - TRIPLE + 2)) // PART + 1)
    with large_rows(spark):  # a block is a row
        stretches = _candidates(blocks, parts, span)
    dropped(blocks)
    # ids are numbered by what the sort compares: their order is all that counts
    ranked = staged(_ranked(stretches.select("key").distinct().join(first, "key")))
    size = stretches.agg(F.sum(F.length("data"))).first()[0] or 0
    found = stretches.dropDuplicates(["key", "offset"]).join(ranked, "key")
    dealt = found.repartitionByRange(max(1, size // BLOCK + 1), "print", "key", "offset").sortWithinPartitions("print", "key", "offset")
    blocks = staged(dealt.select("rank", "key", "offset", "data").mapInArrow(_stretch_blocks, _PARTS_DDL))
    dropped(stretches)
    with large_rows(spark):
        depth = 2 * TRIPLE if span >= 2 * TRIPLE + 2 else TRIPLE
        blocks = _answered(blocks, lambda b, _, every, d=depth: b.rows(b.sampled(d)[::every], d), lambda b, _, text=True, d=depth: b.triples(d, text), depth // 8)
        while 2 * depth + 2 <= span:
            blocks = _answered(blocks, *_keys(lambda b, names, every=1, d=depth: b.doubled(names, d, every), unique_rows), 2)
            depth *= 2
        gone = _answered(blocks, *_keys(lambda b, names, every=1: b.merged(names, depth, span, every), unique_by_way), 1 + (span - depth > 2), span=span)
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("gone"))  # at most one interval for `span` bytes of a text
    reps = keyed.join(gone, "key").join(first, "key").where("id = rep").dropDuplicates(["key"]).select("key", "text", "gone")
    cut = staged(reps.mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string"))
    return known, first, cut


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Remove each byte covered by a string of `span` bytes that also starts in a document with a smaller id.

    Equal texts are one text, that of the smallest id; in the others, all of it repeats. First,
    fingerprints chosen by content rule out strings that lie in one text only. What is left is
    sorted to the depth of `span` bytes by a difference cover modulo 3: the triples of eight-byte
    words (of sixteen, if the span has 50 or more) at positions 1 and 2 are sorted and named by rank;
    pairs of names are sorted and named in turn, until they are that deep, and names that one
    document alone holds drop out at each level; then suffixes of any two classes modulo 3 merge in the way in which both go on with a named
    suffix, and among adjacent equal prefixes the smallest id counts. Each sort sends a block's
    distinct keys to ranges of keys and gets their numbers back. Stretches of text that begin alike
    lie in one block, so most copies meet there and are sent once.

    Returns one row per input row: id, n_bytes, n_removed, n_spans and kept_sha256. Null texts are
    empty; rows with a null id are returned whole and take no part; rows that repeat an id aren't
    compared with one another; an empty table gives no rows. Ids of any type that sorts will do.
    `span` must be 26 or more.
    """
    if span < TRIPLE + 2:
        raise ValueError(f"span must be {TRIPLE + 2} or more")
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    rows = ids_only(docs, id=doc_id, text=text).select("id", body.alias("text"))
    keyed = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    with shuffles_removed(spark):
        known, first, cut = _cuts(keyed, span)
    copy = F.col("rep").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("rep"))
    left = F.sha2(F.lit("").cast("binary"), 256)
    sizes = known.join(first, "key", "left").join(cut, "key", "left")
    return sizes.select(
        "id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(F.col("id").isNotNull(), F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(F.col("id").isNotNull(), F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, left).when(F.col("id").isNotNull(), F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def _ranked(reps: DataFrame) -> DataFrame:
    """Texts (key, rep) with a number that grows with rep: rank by ranges of ids and their counts."""
    if dict(reps.dtypes)["rep"] in ("bigint", "int", "smallint", "tinyint"):
        return reps.select("key", F.col("rep").cast("long").alias("rank"))
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged(reps).repartitionByRange(parts, "rep").sortWithinPartitions("rep")
    # within a range the number counts on from its partition's own first number
    return ordered.withColumn("rank", F.monotonically_increasing_id()).select("key", "rank")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact removal of repeated strings leaves of every document."""
    return without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
