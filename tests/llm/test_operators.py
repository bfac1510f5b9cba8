"""The operators against brute force, exact round trips and defined edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelweave.llm import _common, embedding_dedup, language, near_dedup, neighbours, packing, registry, sentencepiece_bpe, sharding, substring_dedup, suffix_dedup, toxicity
from tests.conftest import SF

SF01 = SF.replace("sf0.001", "sf0.01")

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lis", "mo")]
EDGES = [(9001, None), (9002, ""), (9003, " \n "), (9004, "ü" * 40000), (None, "no id here")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(500, 60)
    rows = [(i, prose(i, 120)) for i in range(20)]
    rows += [(i, f"{prose(i, 30)} {shared} {prose(i + 900, 30)}") for i in range(20, 26)]
    rows += [(30, rows[3][1]), (31, rows[3][1] + " end"), (32, rows[4][1]), *EDGES]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, lang string, id int, key int"), rows


@pytest.fixture(scope="module")
def empty(docs):
    return docs[0].where("false")


def test_suffix_dedup(docs, empty):
    got = {r["id"]: r for r in suffix_dedup.without_repeats(docs[0]).collect()}
    first: dict[bytes, int] = {}
    for i, t in docs[1]:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in docs[1]:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_packing(docs, empty):
    got = packing.packed(docs[0], window=64, group=50).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in docs[1]:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for r in pieces:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= 64
    assert packing.packed(empty).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = random.Random(1).choices(range(1, 64), k=300)
    into, offset = packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fit = [r for r in rooms if r >= lengths[i]]
        room = min(fit) if fit else 64
        if fit:
            rooms.remove(room)
        assert offset[i] == 64 - room
        rooms.append(room - lengths[i])
    assert len(set(into)) == len(rooms)


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: r for r in substring_dedup.repeated_chunks(docs[0]).collect()}
    text = dict(docs[1])
    assert got[30]["text_left"] == "" and got[30]["n_removed"] == len(text[30])
    assert all(got[i]["n_removed"] > 100 for i in range(21, 26))
    assert all(got[i]["text_left"] == text[i] for i in [*range(21), 9001, 9002, 9003, None])
    assert substring_dedup.repeated_chunks(empty).count() == 0


def test_substring_dedup_takes_whole_passages(spark):
    """Passages of 51 to 100 words go to their first and last byte, but for a few without a chunk inside."""
    planted = [prose(7000 + k, 51 + k % 50) for k in range(100)]
    rows = [(2 * k + j, f"{prose(3 * k + j, 40)} é{p}ü {prose(9000 + 2 * k + j, 40)}") for k, p in enumerate(planted) for j in (0, 1)]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = [got[2 * k + 1]["n_removed"] / len(p.encode()) for k, p in enumerate(planted)]
    assert all(got[2 * k]["n_removed"] == 0 for k in range(100))
    assert sum(r >= 1 for r in removed) >= 97 and np.mean(removed) > 0.97, sorted(removed)[:10]


def test_near_dedup(docs, empty):
    got = {r["id"]: r["group_id"] for r in near_dedup.near_duplicates(docs[0]).collect()}
    rows = [(i, t) for i, t in docs[1] if i is not None]
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and i < 9000 and j < 9000 and near_dedup.bag_overlap(a or "", b or "") >= 0.8:
                group[j] = min(group[j], group[i])
    assert {i: got[i] for i in group} == group and got[None] is None
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shards_by_bytes(docs[0].where("length(coalesce(text, '')) < 5000"), 4).collect()
    assert len(got) == len(docs[1]) - 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shards_by_bytes(empty, 4).count() == 0


def test_sharding_is_balanced_and_contiguous(docs, spark):
    rows = spark.createDataFrame([(i, prose(i, 20 + i % 30)) for i in range(400)] + [(900, "same"), (901, "same"), (901, "same")], "doc_id long, text string")
    got = sharding.shards_by_bytes(rows, 8).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert len(got) == 403 and max(sizes) - min(sizes) <= 0.1 * np.mean(sizes) + 2 * max(r["size"] for r in got)
    assert len({r["shard"] for r in got if r["id"] in (900, 901)}) == 1


def test_language_held_out(spark):
    """Accuracy on the fold that is never learned from, and defined answers in the edge cases."""
    got = language.op1_language_id(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).collect()
    assert len(held) > 200 and np.mean([r["ok"] for r in held]) >= 0.97


def test_toxicity_held_out(spark):
    """On a table with enough toxic documents to learn from and to count."""
    many = SF.replace("sf0.001", "sf0.1")
    got = toxicity.op10_toxicity(spark, many).join(spark.read.parquet(f"{many}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.01


def test_toxicity_gradient():
    """The gradient of the loss against differences, for every kind of weight."""
    texts = ["Ünder the bridge a fox, çé!", "", "one twö three four five six seven", "x", "a b c d e f g"]
    of = toxicity.words_of(*_common.text_bytes(pa.array(texts)))
    assert of.per_text.tolist() == [6, 0, 7, 1, 7]
    net = toxicity.started(3, np.float64)
    begin, count, doc = toxicity.windows_of(of.per_text)
    token = np.append(of.token, np.zeros(toxicity.LENGTH, int))
    t, mask = token[begin[None, :] + np.arange(toxicity.LENGTH)[:, None]], (np.arange(toxicity.LENGTH)[:, None] < count).astype(float)
    y, weight = np.array([1.0, 0.0, 0.0, 1.0, 1.0]), np.array([0.2, 0.1, 0.3, 0.2, 0.2])
    _, g = net.gradient(of, t, mask, y, weight)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, ends = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = was + step
            ends.append(net.gradient(of, t, mask, y, weight)[0])
        net.p[name][at] = was
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[name][at], rel=2e-2, abs=2e-5), name


def test_toxicity_reads_every_character():
    """Words that differ in one character in the middle, or in case only, get different, or the same, inputs."""
    of = toxicity.words_of(*_common.text_bytes(pa.array(["extraordinarily extraoädinarily EXTRAORDINARILY ÄB äb"])))
    net = toxicity.started(1)
    x = net.vectors(of, np.arange(len(of.word)))[of.token]
    assert not np.allclose(x[0], x[1]) and not np.allclose(x[0, 8:], x[1, 8:])
    assert np.allclose(x[0], x[2]) and np.allclose(x[3], x[4])


def test_language_and_toxicity_edges(docs, empty, spark):
    """Null, empty and very long texts, null ids, an empty table, and columns with the names of the answers."""
    net = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    clash = docs[0].withColumns({"score": F.lit("x"), "lang_pred": F.lit(7)})
    for made in (net, None):
        got = {r["doc_id"]: r for r in language.with_language(clash, made).collect()}
        assert len(got) == len(docs[1]) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (9001, 9002, 9003))
        assert language.with_language(empty, made).count() == 0
    tox = toxicity.train(spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet"))
    for made in (tox, None):
        got = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(clash, made).collect()}
        assert len(got) == len(docs[1]) and all(0 <= v <= 1 for v in got.values()) and got[9001] == got[9002] == got[9003]
        assert toxicity.with_toxicity(empty, made).count() == 0
    assert _common.crc_mod("doc_id", 3) is not None and docs[0].where(_common.crc_mod("doc_id", 3).isNull()).count() == 0


def test_repeated_and_text_ids(spark):
    """Rows that repeat an id with another text are told apart; ids may be texts; extra columns may clash."""
    a, b, c = (prose(k, 120) for k in (71, 72, 73))
    rows = spark.createDataFrame([("1", a), ("2", b), ("2", f"{c} {a}"), ("1", a)], "doc_id string, text string")
    clash = rows.withColumns({"n_bytes": F.lit("x"), "_ends": F.lit(1), "text_left": F.lit(0)})
    got = sorted((r["doc_id"], r["n_removed"], r["text_left"]) for r in substring_dedup.repeated_chunks(clash).collect())
    assert got[:3] == sorted([("1", 0, a), ("1", 0, a), ("2", 0, b)]) and got[3][1] >= len(a) and b"".join([got[3][2].encode()]).decode().startswith(c[:-60])
    got = sorted((r["id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.without_repeats(rows).collect())
    assert got == sorted([("1", len(a), 0), ("1", len(a), 0), ("2", len(b), 0), ("2", len(c) + 1 + len(a), len(a))])
    for order in ((0, 1), (1, 0)):
        texts = [(1, a), (1, b)]
        near = spark.createDataFrame([texts[order[0]], texts[order[1]], (2, b + " end")], "doc_id long, text string")
        assert sorted((r["id"], r["group_id"]) for r in near_dedup.near_duplicates(near).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert {r["id"] for r in packing.packed(rows).collect()} == {r["id"] for r in sentencepiece_bpe.coded(rows).collect()} == {"1", "2"}


@pytest.mark.parametrize("span", [26, 75, 130])
def test_suffix_dedup_of_any_span(spark, span):
    shared = prose(501, 60)
    rows = [(i, f"{prose(i, 30)} {shared[: 40 * (i % 5)]} {prose(i + 900, 30)}") for i in range(30)]
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=span).collect()}
    first: dict[str, int] = {}
    for i, t in rows:
        for p in range(len(t) - span + 1):
            first.setdefault(t[p : p + span], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = True
        assert got[i] == gone.sum()


def test_descent_rounds_find_neighbours(spark):
    """The rounds of NN-descent, not the cells that they start from, find most of the neighbours."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "u long, vec binary")
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -9
    truth = [set(r) for r in np.argsort(-s, axis=1)[:, :20].tolist()]

    def recall(graph):
        return np.mean([len(truth[r["u"]] & set(r["ids"][:20])) / 20 for r in graph.where("u < 200").collect()])

    trace = []
    neighbours.descent(nodes, 5000, rounds=4, trace=trace)
    found = [recall(g) for g in trace]
    assert found[-1] >= 0.8 and found[-1] > found[0] + 0.1, found


def test_pipeline_against_brute_force(spark, tmp_path):
    """The stages on a small table: toxic, unknown and near-copied documents go, passages are cut, the rest is packed."""
    base = spark.read.parquet(f"{SF01}/documents.parquet")
    base.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF01}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = base.withColumns({"_toxic": F.lit("kept"), "_id": F.lit(3)})
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        docs = _common.staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        after = docs.select("doc_id", "text").collect()
        sizes.append(len(after))
        if name == "near_dedup":  # of any two texts that are left, none is a near copy of the other, and each group keeps its smallest id
            left = {(r["doc_id"], r["text"]) for r in after}
            assert left <= before and len({i for i, _ in left}) == len(left)
            bags = [(i, set(zip(*(t.split()[k:] for k in range(5)), strict=False))) for i, t in sorted(left)]
            hold: dict[tuple, list[int]] = {}
            for k, (_, bag) in enumerate(bags):
                for x in bag:
                    hold.setdefault(x, []).append(k)
            texts = dict(left)
            pairs = {(a, b) for ks in hold.values() if len(ks) < 40 for a in ks for b in ks if a < b}
            assert not any(near_dedup.bag_overlap(texts[bags[a][0]], texts[bags[b][0]]) >= 0.8 for a, b in pairs)
        if name == "substring_dedup":
            assert {r["doc_id"] for r in after} == {i for i, _ in before}
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 500
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_sentencepiece_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in sentencepiece_bpe.op6_sentencepiece(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = p.encode(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.02, size=(20, 8)), base[:3]])
    rows = [(i, v.tolist(), i % 3 if i < 60 else i % 60 % 3) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 7 + [None], 1), (904, x[0].tolist(), None)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), x, [r[2] for r in rows]


def test_embedding_dedup(vectors):
    df, x, labels = vectors
    got = {r["id"]: r for r in embedding_dedup.near_vectors(df, shard=10).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None])
    for i in range(len(x)):
        assert got[i]["n_links"] == near[i].sum() - 1
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 905))


def test_embedding_dedup_finds_near_pairs(spark):
    """Many real near pairs over several shards."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1200, 16))
    x = np.concatenate([base, base[:600] + rng.normal(scale=0.12, size=(600, 16)), base[:30].repeat(10, axis=0) + rng.normal(scale=0.05, size=(300, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in embedding_dedup.near_vectors(df, shard=500).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    links = sum(got.values())
    assert truth.sum() > 1000 and all(got[i] <= truth[i] for i in got) and links >= 0.98 * truth.sum()
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0 and neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_neighbours(vectors):
    df, x, _ = vectors
    got = neighbours.nearest(df, F.col("id") % 20 == 0, top=5).collect()
    hits = wanted = 0
    every = np.concatenate([x, x[:1]])
    ids = [*range(len(x)), 904]
    for q in (i for i in ids if i % 20 == 0):
        s = every @ every[ids.index(q)]
        order = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-s[k], ids[k]))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 6))
        hits, wanted = hits + len({r["vec_id"] for r in mine} & {ids[k] for k in order}), wanted + 5
    assert hits >= 0.9 * wanted


def test_neighbours_among_near_copies(spark):
    """More distinct near copies than a beam holds, nearer to each other than one-byte codes tell."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(1, 16)) + rng.normal(scale=1e-5, size=(400, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for asked, recall in ((F.col("id") % 40 == 0, neighbours.RECALL), (F.col("id") % 50 == 1, 1.1)):
        got: dict[int, set[int]] = {}
        for r in neighbours.nearest(df, asked, recall=recall, beam=neighbours.BEAM if recall < 1 else 1024).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        found = [len(got[i] & set(np.argsort(-s[i])[:20].tolist())) for i in got if i >= 200 or recall > 1]
        assert found and sum(found) == 20 * len(found)


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_embedding_dedup_of_any_norm(spark):
    """Very long and very short vectors are compared by their directions."""
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_neighbours_over_shards(spark, monkeypatch):
    """Several shards, ties, repeated ids, copies, odd rows and clashing columns, against brute force."""
    monkeypatch.setattr(neighbours, "SHARD", 300)
    r = np.random.default_rng(8)
    x = r.normal(size=(1000, 12))
    x[500:540] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (None, rows[3][1]), (2003, [1.0]), rows[5]]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, u int, shard int, audit string")
    got: dict[int, list] = {}
    for g in neighbours.nearest(df, F.col("id") % 25 == 0).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert sorted(got) == list(range(0, 1000, 25))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1000), -np.round(s, 9)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits >= 0.95 * 20 * len(got)


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Columns named as an operator's own come out of every stage as they went in; empty tables pass, null and empty texts have their place."""
    shared = prose(77, 90)
    rows = [(k, f"{prose(k, 60)} {shared} {prose(k + 50, 60)}", None, "s", 9, f"mine {k}", "a", "b", "c", "d") for k in range(4)]
    rows += [(8, None, None, "s", 0, "n", "a", "b", "c", "d"), (9, "", None, "s", 0, "e", "a", "b", "c", "d"), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, n_removed string, n_spans string, text_left string, kept string")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name != "language_id":  # without a label no language is known
            kept = out.collect()
            assert {(r["n_bytes"], r["n_removed"], r["n_spans"], r["text_left"], r["kept"]) for r in kept} == {r[5:] for r in rows}, name
            assert {r["text"] for r in kept if r["doc_id"] in (8, 9)} == {None, ""}, name
            assert len(kept) == (6 if name == "near_dedup" else len(rows)), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("most", [0, 1, 50, 1 << 20, (1 << 64) - 1])
def test_rows_of_numbers_are_sorted_once(width, most):
    r = np.random.default_rng(width)
    for n in (1, 2, 17, 20_000):
        keys = r.integers(0, most, (n, width), dtype=np.uint64, endpoint=True)
        distinct, place = suffix_dedup.unique_rows(keys)
        want, at = np.unique(keys, axis=0, return_inverse=True)
        assert (distinct == want).all() and (place == at.ravel()).all()
    assert len(suffix_dedup.unique_rows(keys[:0])[0]) == 0


@pytest.mark.parametrize("letters", [1, 2, 60, 256])
@pytest.mark.parametrize("depth", [24, 48])
def test_triples_of_a_block(letters, depth):
    """Sorted strings and places against sorting of slices; the codes of sorted keys give the same places again, in less room."""
    r = np.random.default_rng(letters)
    pieces = [r.integers(0, letters, n, dtype=np.uint8).tobytes() for n in (0, 1, 47, 48, 49, 50, 700)]
    pieces = [*pieces, pieces[-1][100:400], pieces[-1]]
    block = suffix_dedup.Block(np.cumsum([len(x) for x in pieces]).astype(np.int64).tobytes(), b"".join(pieces))
    keys, place, at = block.triples(depth)
    want = [p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1) if i % 3]
    keys = [x.ljust(depth, b"\0") for x in keys.tolist()]  # numpy leaves off zeros
    assert keys == sorted(set(want)) and [keys[k] for k in place] == want and len(at) == len(want)
    rows = np.array(keys, f"S{depth}")
    code = suffix_dedup._coded(rows)
    lengths, many, again = suffix_dedup._places([code, code], depth // 8)
    assert lengths == [len(keys)] * 2 and many == len(keys) and again.tolist() == [*range(len(keys))] * 2
    assert letters == 256 or len(keys) < 100 or len(code) < 0.7 * rows.nbytes


@pytest.mark.parametrize("most", [0, 1, 1 << 20, (1 << 64) - 1])
def test_ranks_of_numbers_of_any_size(most):
    for n in (0, 1, 2, 1024, 20_000):
        code = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64, endpoint=True)
        one, place = suffix_dedup.ranks(code)
        want, again = np.unique(code, return_inverse=True)
        assert (code[one] == want).all() and (place == again).all()


@pytest.mark.parametrize("span", [49, 50, 51, 98])
def test_suffix_dedup_at_the_edges_of_a_level(spark, monkeypatch, span):
    """Cut texts, many ranges and texts that share a little less or more than the span; two sorts do at 50 and 51, three at 98."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "PART", 3000)
    levels, answered = [], suffix_dedup._answered
    monkeypatch.setattr(suffix_dedup, "_answered", lambda *a, **b: levels.append(a[3]) or answered(*a, **b))
    shared = prose(502, 60)
    rows = [(i, f"{prose(i, 9)}{shared[i : i + span + i % 4 - 1]}{prose(i + 900, 3)}") for i in range(12)] + [(12, shared * 4), (13, shared[:200])]
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=span).collect()}
    first: dict[str, int] = {}
    for i, t in rows:
        for p in range(len(t) - span + 1):
            first.setdefault(t[p : p + span], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = True
        assert got[i] == gone.sum(), (span, i)
    assert len(levels) == (3 if span == 98 else 2)


def test_suffix_dedup_ranges_of_fingerprints_are_even():
    """Fingerprints are smallest hashes; the ranges that they are dealt to hold about equally many all the same."""
    text = np.random.default_rng(5).integers(97, 123, 300_000).astype(np.uint8).tobytes()
    row = {"ends": np.array([len(text)]).tobytes(), "data": text, "keys": bytes(16)}
    *_, prints, _ = suffix_dedup._distinct_prints(row, 50)
    many = np.bincount(suffix_dedup._range_of_print(prints, 40).astype(int), minlength=40)
    assert len(prints) > 15_000 and many.max() < 1.5 * many.mean() and (np.diff(prints.astype(object)) > 0).all()


def test_suffix_dedup_sorts_a_block_in_parts(spark, monkeypatch):
    """What is sorted at once is less than what asks the ranges together: rows follow blocks and ranges alone, the result is that of brute force."""
    for name, size in (("BLOCK", 3000), ("SORTED", 500), ("PART", 2000)):
        monkeypatch.setattr(suffix_dedup, name, size)
    shared = prose(503, 90)
    rows = [(i, f"{prose(i, 9)}{shared[i * 3 : i * 3 + 60 + i % 4]}{prose(i + 900, 30)}") for i in range(40)] + [(40, shared * 3), (41, shared[:200])]
    got = {r["id"]: r["n_removed"] for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    first: dict[str, int] = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        assert got[i] == gone.sum()
    text = b"".join(t.encode() for _, t in rows)
    row = {"ends": np.arange(400, len(text), 400).tobytes(), "data": text}
    lists = [(a, s, len(block.data)) for a, s, block in suffix_dedup._runs(row)]
    assert len(lists) > 5 and [s for _, s, _ in lists] == np.cumsum([0, *(n for *_, n in lists[:-1])]).tolist() and all(s == 400 * a for a, s, _ in lists)


def test_neighbours_shards_are_rows_of_few_nodes():
    """A shard is sent in slices, not as one row, and answers all blocks of queries that come with it as a scan does."""
    rng = np.random.default_rng(6)
    n = 2 * neighbours.SLICE + 500
    x, ids = rng.normal(size=(n, 8)).astype(np.float32), rng.permutation(n).astype(np.int64)
    near = [rng.choice(ids, 5, replace=False).tolist() for _ in range(n)]
    part = pa.table({"u": ids, "shard": np.zeros(n, np.int64), "v": pa.array(x.tolist(), pa.list_(pa.float32())), "near": pa.array(near, pa.list_(pa.int64()))})
    held = neighbours._packed(part)
    assert held.num_rows == 3 and max(len(r) for r in held.column("ids").to_pylist()) == 8 * neighbours.SLICE
    asks = pa.table({"u": ids[:30], "v": pa.array(x[:30].astype(float).tolist(), pa.list_(pa.float64())), "block": np.arange(30) % 3})
    got = neighbours._answers(5, 10, 4, 1.1, np.float32)(held.take([2, 0, 1]), asks).to_pandas()
    for k in range(30):
        s = x.astype(float) @ x[k].astype(float)
        s[k] = -np.inf
        mine = got[(got["u"] == ids[k]) & (got["w"] != ids[k])].sort_values("s", ascending=False)
        assert mine["w"].tolist() == ids[np.argsort(-s)[:10]].tolist()
