"""Toxicity by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import by_bytes, crc_mod, ids_only, mixed, table, text_bytes, with_arrow

LENGTH, STEP = 32, 16  # words of a window; windows overlap by half
HIDDEN = 8
#: Rows and width of the embeddings: of words, and of a word's characters with one and with two neighbours on each side.
BUCKETS = {"word": (1 << 14, 8), "three": (1 << 13, 8), "five": (1 << 15, 8)}
WIDTH = sum(w for _, w in BUCKETS.values())
SAMPLE = 2000  # toxic documents that the network learns from, about; twice as many others
WINDOWS = 64  # windows of one document that it learns from at most, spread evenly; scores read all
HELD_OUT = 5  # crc32(id) mod 5 = 0 is never learned from
_U = np.uint64


def _hashed(*codes: np.ndarray) -> np.ndarray:
    out = np.zeros(codes[0].shape, _U)
    for c in codes:
        out = mixed(out ^ (c.astype(_U) + _U(1)))
    return out


@dataclass
class Words:
    """The words of some texts: `token` names each one's place among the distinct words, `per_text` counts them.

    A distinct word has a bucket, and for each of its characters the buckets of the character with its
    neighbours: those of word k are at `start[k]` to `start[k + 1]`.
    """

    token: np.ndarray
    per_text: np.ndarray
    key: np.ndarray  # a hash of each distinct word
    word: np.ndarray
    start: np.ndarray
    three: np.ndarray
    five: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts in UTF-8: longest runs of ASCII letters and digits and characters from 128 on, in lower case (ASCII and Latin-1)."""
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
    place = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]  # the texts' first characters
    upper = (code >= 65) & (code <= 90) | (code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)
    code = code + 32 * upper
    solid = (code >= 48) & (code <= 57) | (code >= 97) & (code <= 122) | (code >= 128)
    n = len(code)
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = place[1:-1][(place[1:-1] > 0) & (place[1:-1] < n)]
    begin[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    per_text = np.bincount(np.searchsorted(place, s, side="right") - 1, minlength=len(offsets) - 1)
    size = e - s
    at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())  # the words' characters
    first, end = np.repeat(s, size), np.repeat(e, size)
    near = [np.where((at + d >= first) & (at + d < end), code[np.clip(at + d, 0, max(n - 1, 0))], 0) if n else at for d in (-2, -1, 0, 1, 2)]
    begins = np.cumsum(size) - size
    own = _hashed(near[2], at - first)
    whole = np.add.reduceat(own, begins) if len(s) else own  # sums of hashes of characters and their places
    _, one, token = np.unique(whole, return_index=True, return_inverse=True)
    start = np.append(0, np.cumsum(size[one]))
    chars = np.repeat(begins[one] - start[:-1], size[one]) + np.arange(start[-1])
    bits = {k: _U(64 - int(np.log2(rows))) for k, (rows, _) in BUCKETS.items()}
    three, five = (_hashed(*(c[chars] for c in near[2 - r : 3 + r])) >> bits[k] for k, r in (("three", 1), ("five", 2)))
    return Words(token.astype(np.int32), per_text, whole[one], (mixed(whole[one]) >> bits["word"]).astype(np.int32), start, three.astype(np.int32), five.astype(np.int32))


def joined(parts: list[Words]) -> Words:
    """The words of all texts, each distinct one once."""
    key, one, place = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    shift, chars = np.cumsum([0, *(len(p.word) for p in parts)]), np.cumsum([0, *(len(p.three) for p in parts)])
    start, end = (np.concatenate([p.start[s : len(p.word) + s] + c for p, c in zip(parts, chars, strict=False)])[one] for s in (0, 1))
    size = end - start
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    every = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("word", "three", "five")}
    token = np.concatenate([place[p.token + k] for p, k in zip(parts, shift, strict=False)]).astype(np.int32)
    return Words(token, np.concatenate([p.per_text for p in parts]), key, every["word"][one], np.append(0, np.cumsum(size)), every["three"][at], every["five"][at])


def windows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; a text without words has an empty window."""
    count = np.maximum(1, -(-(words - LENGTH + STEP) // STEP))
    doc = np.repeat(np.arange(len(words)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(words) - words
    return begin[doc] + k * STEP, np.clip(words[doc] - k * STEP, 0, LENGTH), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Gru:
    """Embeddings, two gated recurrent layers (forwards and backwards), attention and an output unit."""

    p: dict[str, np.ndarray]

    def vectors(self, of: Words, some: np.ndarray) -> np.ndarray:
        """Inputs of these distinct words: the word's embedding, and the means of its characters' embeddings; last, a row of zeros for no word."""
        out = np.zeros((len(some) + 1, WIDTH), self.p["word"].dtype)
        for s in range(0, len(some), 1 << 14):
            part, here = some[s : s + (1 << 14)], slice(s, min(len(some), s + (1 << 14)))
            chars, cut, size = _characters(of, part)
            out[here, :8] = self.p["word"][of.word[part]]
            for k, (name, buckets) in enumerate((("three", of.three), ("five", of.five)), 1):
                out[here, 8 * k : 8 * k + 8] = np.add.reduceat(self.p[name][buckets[chars]], cut, axis=0) / size[:, None]
        return out

    def run(self, proj: np.ndarray, mask: np.ndarray, way: str, trace: list | None = None) -> np.ndarray:
        """States of one direction; proj: (time, windows, 3 * HIDDEN), mask: (time, windows)."""
        u, h = self.p[f"u_{way}"], np.zeros((proj.shape[1], HIDDEN), np.float32)
        states = np.empty((*proj.shape[:2], HIDDEN), np.float32)
        for t in range(len(proj)) if way == "f" else range(len(proj) - 1, -1, -1):
            gates = _sigmoid(proj[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(proj[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            on = mask[t][:, None]
            if trace is not None:
                trace.append((t, h, z, r, c, on))
            h = h + on * z * (c - h)
            states[t] = h
        return states

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention over time: softmax of a learned score."""
        e = np.where(mask > 0, states @ self.p["attend"], -1e9)
        a = np.exp(e - e.max(axis=0)) * np.maximum(mask, 1e-30)
        a /= a.sum(axis=0)
        return np.einsum("tw,twh->wh", a, states), a

    def probability(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows; x: (time, windows, inputs)."""
        states = np.concatenate([self.run(x @ self.p[f"w_{k}"] + self.p[f"b_{k}"], mask, k) for k in "fb"], axis=2)
        pool, _ = self.pooled(states, mask)
        return _sigmoid(pool @ self.p["out"] + self.p["out_bias"][0])

    def gradient(self, of: Words, tokens: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted cross entropy and its gradient. tokens: (time, windows)."""
        p = self.p
        some, place = np.unique(tokens, return_inverse=True)
        place = place.reshape(tokens.shape)
        x, g = self.vectors(of, some)[np.where(mask > 0, place, len(some))], {k: np.zeros_like(v) for k, v in p.items()}
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(x @ p[f"w_{k}"] + p[f"b_{k}"], mask, k, traces[k]) for k in "fb"], axis=2)
        pool, a = self.pooled(states, mask)
        chance = _sigmoid(pool @ p["out"] + p["out_bias"][0])
        loss = -float((weight * np.log(np.where(y > 0, chance, 1 - chance) + 1e-7)).sum())
        d = ((chance - y) * weight).astype(p["out"].dtype)
        g["out"], g["out_bias"] = pool.T @ d, np.array([d.sum()], p["out"].dtype)
        d_pool = d[:, None] * p["out"]
        d_a = np.einsum("wh,twh->tw", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["attend"] = np.einsum("tw,twh->h", d_e, states)
        d_states = a[:, :, None] * d_pool[None] + d_e[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            u, own = p[f"u_{way}"], d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN]
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, on in reversed(traces[way]):
                d_h = d_h + own[t]
                d_c = d_h * on * z * (1 - c * c)
                d_z = d_h * on * (c - h) * z * (1 - z)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_c], axis=1)
                g[f"w_{way}"] += x[t].T @ d_g
                g[f"b_{way}"] += d_g.sum(axis=0)
                g[f"u_{way}"][:, : 2 * HIDDEN] += h.T @ d_g[:, : 2 * HIDDEN]
                g[f"u_{way}"][:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_x[t] += d_g @ p[f"w_{way}"].T
                d_h = d_h * (1 - on * z) + d_rh * r + d_g[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
        back = _summed(len(some) + 1, np.where(mask > 0, place, len(some)).ravel(), (d_x * mask[:, :, None]).reshape(-1, WIDTH))
        chars, cut, size = _characters(of, some)
        g["word"] = _summed(len(p["word"]), of.word[some], back[:-1, :8])
        for k, (name, buckets) in enumerate((("three", of.three), ("five", of.five)), 1):
            g[name] = _summed(len(p[name]), buckets[chars], np.repeat(back[:-1, 8 * k : 8 * k + 8] / size[:, None], size, axis=0))
        return loss, g


def _summed(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A table with so many rows, the values added up in the rows that they name."""
    return np.stack([np.bincount(at, v, rows) for v in values.T], axis=1)


def _characters(of: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters of these words are, where each word's begin among them, and how many it has."""
    size = of.start[some + 1] - of.start[some]
    cut = np.cumsum(size) - size
    return np.repeat(of.start[some] - cut, size) + np.arange(size.sum()), cut, size


def started(seed: int, kind: type = np.float32) -> Gru:
    """Small random first weights."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1, shape) for k, shape in BUCKETS.items()}
    for way in "fb":
        p |= {f"w_{way}": rng.normal(0, 0.3, (WIDTH, 3 * HIDDEN)), f"u_{way}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b_{way}": np.zeros(3 * HIDDEN)}
    p |= {"attend": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.zeros(1)}
    return Gru({k: np.asarray(v, kind) for k, v in p.items()})


def fitted(of: Words, y: np.ndarray, *, rounds: int = 20, steps: int = 60, batch: int = 128, rate: float = 0.01, learnt: float = 0.005, flat: float = 0.02, seed: int = 11) -> Gru:
    """Learn from documents' words and labels, until a round's mean loss is under `learnt` or no longer falls by a share of `flat`; `rounds` at most.

    A label holds for a document, a score for a window. The first round learns from any windows of
    toxic documents; from then on, those that score highest so far count, more and more of them
    the highest of its document. Of the other documents random and highest windows are taken.
    """
    rng, net = np.random.default_rng(seed + 1), started(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    token = np.append(of.token, np.zeros(LENGTH, np.int64))
    begin, count, doc = windows_of(of.per_text)
    nth, of_doc = np.arange(len(doc)) - np.searchsorted(doc, doc), np.maximum(np.bincount(doc)[doc], WINDOWS)
    even = nth * WINDOWS // of_doc != (nth - 1) * WINDOWS // of_doc
    begin, count, doc = begin[even], count[even], doc[even]
    cell = lambda i: (token[begin[i][None, :] + np.arange(LENGTH)[:, None]], (np.arange(LENGTH)[:, None] < count[i]).astype(np.float32))
    toxic, step, before = y[doc] == 1, 0, np.inf
    if not toxic.any() or toxic.all():
        return net
    score = rng.random(len(doc))
    for turn in range(rounds):
        if turn:
            every = net.vectors(of, np.arange(len(of.word)))
            score = np.concatenate([net.probability(every[np.where(k > 0, t, -1)], k) for t, k in map(cell, np.array_split(np.arange(len(doc)), 1 + len(doc) // 1024))])
        order = np.lexsort((-score, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        keep = max(1, 8 >> turn)  # windows of each toxic document
        pos, hard, easy = order[toxic[order] & (place < keep)], order[~toxic[order] & (place == 0)], np.flatnonzero(~toxic)
        total = 0.0
        for _ in range(steps):
            step += 1
            some, near = batch * 5 // 16, batch * 11 // 32  # of toxic documents, and of the highest of others
            i = np.concatenate([rng.choice(pos, some), rng.choice(hard, near), rng.choice(easy, batch - some - near)])
            t, mask = cell(i)
            loss, g = net.gradient(of, t, mask, toxic[i].astype(np.float32), np.full(len(i), 1 / len(i), np.float32))
            total += loss / steps
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if turn > 3 and (total < learnt or total > before * (1 - flat)):
            break
        before = total
    return net


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Gru | None:
    """Learn from up to `sample` toxic documents and twice as many others, outside the held-out fold.

    They are the first ones in the order of a hash of the id, and their texts reach the driver.
    An id with several labels counts as toxic if one says so; null ids and labels are left out.
    None if there is no document of either label.
    """
    marks = ids_only(labels, id=doc_id, toxic=toxic).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("id", HELD_OUT) != 0))
    marks = marks.groupBy("id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    first = lambda label, n: marks.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = first(1, sample).unionByName(first(0, 2 * sample))
    rows = ids_only(docs, id=doc_id, text=text).join(F.broadcast(chosen), "id")  # at most 3 * sample marks
    got = rows.select(F.xxhash64("id").alias("h"), "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    got.sort(key=lambda r: (r["h"], r["text"]))
    y = np.array([r["toxic"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    texts = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in got], pa.large_string())], names=["text"])
    return fitted(joined([words_of(*text_bytes(part.column("text"))) for part in by_bytes(texts, "text")]), y)


def _scorer(shared, text: str):
    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        net = shared.value
        of = words_of(*text_bytes(batch.column(text)))
        best, every = np.zeros(batch.num_rows), net.vectors(of, np.arange(len(of.word)))
        token = np.append(of.token, np.full(LENGTH, -1))
        begin, count, doc = windows_of(of.per_text)
        for s in range(0, len(doc), 1024):
            b, n = begin[s : s + 1024], count[s : s + 1024]
            mask = np.arange(LENGTH)[:, None] < n
            x = every[np.where(mask, token[b[None, :] + np.arange(LENGTH)[:, None]], -1)]
            np.maximum.at(best, doc[s : s + 1024], net.probability(x, mask.astype(np.float32)))
        return [pa.array(np.clip(best, 0, 1))]

    return score


def with_toxicity(docs: DataFrame, net: Gru | None, *, text: str = "text", score: str = "score") -> DataFrame:
    """Add a column with the toxicity of each whole text: the highest score of its overlapping windows of LENGTH words.

    Null and empty texts, and texts without words, get the score of an empty window; without a
    network every score is 0. Every row stays, with its other columns, whatever its id; equal texts
    get equal scores, and an empty table stays empty. A column that has the name `score` is replaced.
    """
    if net is None:
        return docs.withColumn(score, F.lit(0.0))
    return with_arrow(docs, _scorer(docs.sparkSession.sparkContext.broadcast(net), text), f"`{score}` double", text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = with_toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod("doc_id", HELD_OUT) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
