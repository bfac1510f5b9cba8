"""Edge rows for every operator on documents: null, empty, repeated and very long texts, null ids, clashing columns."""

import hashlib
import random
import zlib

import pytest

from pixelweave.llm import near_dedup, packing, sentencepiece_bpe, sharding, substring_dedup, suffix_dedup

LONG = 400_000  # characters and more of the longest text


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["bali", "dorn", "fumo", "gelis", "kort", "béla", "düno", "fíga"]) + r.choice("xyzvw") for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    passage = prose(1, 70)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, prose(2, LONG // 6)), (5, f"{prose(3, 20)} {passage} {prose(4, 20)}"), (6, f"{prose(5, 20)} {passage} {prose(6, 20)}"),
        (7, prose(7, 40)), (7, prose(7, 40)), (7, prose(8, 40)), (None, prose(7, 40)), (None, None), (8, "  two  spaces   and　more  "), (9, "𝄞é" * 30), (10, "▁ ▁▁ x"),
    ]
    names = "doc_id long, text string, id string, key string, size int, shard string, slot int, left string, rank int, block int, kept string"
    return spark.createDataFrame([(*r, *"abc"[:2], 1, "s", 2, "l", 3, 4, "k") for r in rows], names).repartition(3), rows


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))


def test_suffix_dedup_of_edge_rows(edge, monkeypatch):
    """Blocks smaller than the longest text: it is cut into overlapping pieces, and the result is the same."""
    df, rows = edge
    got = []
    for size in (suffix_dedup.BLOCK, 50_000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", size)
        got.append(sorted(map(tuple, suffix_dedup.without_repeats(df).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for i, n, removed, spans, sha in got[0]:
        if i is None or i in (1, 2, 3):
            texts = [t or "" for j, t in rows if j == i]
            assert removed == spans == 0 and sha in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
            assert n in {len(t.encode()) for t in texts}
    assert next(r for r in got[0] if r[0] == 6)[2] >= len(prose(1, 70).encode())


def test_packing_of_edge_rows(edge):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = edge
    got = packing.packed(df).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held, want = {}, []
    for r in got:
        held.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(ids)))
        if i == 4:
            pieces = sorted((r for r in got if r["id"] == 4), key=lambda r: r["start"])
            assert len(pieces) > 50 and sum(r["length"] for r in pieces) == len(ids)
            assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    assert sorted(((r["id"], r["doc_tokens"]) for r in got if r["start"] == 0), key=str) == sorted(want, key=str)
    for pieces in held.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= 2048


def test_substring_dedup_of_edge_rows(edge):
    df, rows = edge
    out = substring_dedup.repeated_chunks(df)
    got = [(r["doc_id"], r["text"], r["text_left"], r["n_removed"]) for r in out.collect()]
    assert sorted_rows(got)[0][0] is None and len(got) == len(rows)
    assert sorted_rows([g[:2] for g in got]) == sorted_rows(rows)
    for i, text, left, removed in got:
        if i in (None, 1, 2, 3, 4, 5):
            assert left == text and removed == 0
        if i == 6:
            assert removed >= 0.8 * len(prose(1, 70).encode())
    assert {"id", "key", "size", "left"} <= set(out.columns)


def test_near_dedup_of_edge_rows(edge):
    df, rows = edge
    got = [(r["id"], r["group_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    assert all(g is None and kept for i, g, kept in got if i is None)
    assert all(g == i for i, g, _ in got if i is not None)
    assert sorted(i for i, _, kept in got if i is not None and kept) == [1, 2, 3, 4, 5, 6, *[7] * sum(i == 7 and k for i, _, k in got), 8, 9, 10]


def test_sentencepiece_of_edge_rows(edge):
    """The library's own ids, for runs of spaces and odd characters too."""
    import public_tokenizers
    import sentencepiece

    df, rows = edge
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in rows:
        ids = model.encode(t or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids))))
    assert sorted(map(tuple, sentencepiece_bpe.coded(df).collect()), key=str) == sorted(want, key=str)


def test_sharding_of_edge_rows(edge):
    df, rows = edge
    got = sharding.shards_by_bytes(df, 3).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    for s in range(3):
        own = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
