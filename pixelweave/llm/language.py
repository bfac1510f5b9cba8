"""Language identification by a byte convolutional network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import crc_mod, ids_only, map_arrow, table, text_bytes, with_arrow

LENGTH = 256  # bytes of a window
WIDTHS, FILTERS, DIMS = (2, 3, 5), 16, 8
STEP = LENGTH - max(WIDTHS) + 1  # windows overlap, so that no filter position is lost
SAMPLE = 400  # labelled documents of each language that the network learns from, about
HELD_OUT = (3, 1)  # crc32(id) mod 3 = 1 is never learned from
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Embedding of bytes, filters of several widths side by side in one matrix, max pooling, softmax."""

    langs: list[str]
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # (widest * DIMS) x all filters; rows beyond a filter's width are zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Convolution at every position, then its maximum; also the columns it was made from."""
        x = self.embed[windows]
        widest = max(WIDTHS)
        n = windows.shape[1] - widest + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(widest)], axis=2)
        return (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(len(windows), n, -1), cols

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        conv, _ = self.pooled(windows)
        hidden = np.maximum(conv.max(axis=1) + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the fixed-length windows that cover each text, and the text of each window."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - max(WIDTHS) + 1) // STEP))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[doc] + k * STEP, doc


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of windows; zeros beyond the end of a text."""
    at = starts[:, None] + np.arange(LENGTH)
    return np.where(at < ends[:, None], data[np.minimum(at, len(data) - 1)], 0) if len(data) else np.zeros(at.shape, np.uint8)


def fitted(
    windows: np.ndarray, labels: np.ndarray, docs: np.ndarray, langs: list[str], *, steps: int = 300, batch: int = 96, seed: int = 7
) -> ByteNet:
    """Train by Adam on windows that are cut short at random, so that short texts are learned too.
    Languages count alike, and so do the documents of a language, however many windows they have."""
    rng = np.random.default_rng(seed)
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest, DIMS, total), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(-1, total)
    p = {
        "embed": rng.normal(0, 0.5, (256, DIMS)),
        "filters": rng.normal(0, 0.3, mask.shape) * mask,
        "bias": np.zeros(total),
        "out": rng.normal(0, 0.2, (total, len(langs))),
        "out_bias": np.zeros(len(langs)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    chance = 1 / np.bincount(docs)[docs]
    chance /= np.bincount(labels, chance, len(langs))[labels]
    chance /= chance.sum()
    for step in range(1, steps + 1):
        i = rng.choice(len(windows), batch, p=chance)
        x = windows[i].copy()
        short = rng.integers(12, LENGTH, batch)
        short[rng.random(batch) < 0.5] = LENGTH
        x[np.arange(LENGTH) >= short[:, None]] = 0
        net = ByteNet(langs, **p)
        conv, cols = net.pooled(x)
        best = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + p["bias"]
        hidden = np.maximum(pooled, 0)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(batch), labels[i]] -= 1
        d /= batch
        dh = (d @ p["out"].T) * (pooled > 0)
        patch = cols[np.arange(batch)[:, None], best]  # batch x filters x columns
        g = {
            "out": hidden.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0),
            "filters": np.einsum("bf,bfc->cf", dh, patch) * mask, "embed": np.zeros_like(p["embed"]),
        }
        back = (dh[:, :, None] * p["filters"].T[None]).reshape(batch, total, widest, DIMS)
        seen = x[np.arange(batch)[:, None, None], best[:, :, None] + np.arange(widest)]
        np.add.at(g["embed"], seen, back)
        rate = 0.01 * min(1.0, 2 * (1 - (step - 1) / steps))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ByteNet(langs, **{k: x.astype(np.float32) for k, x in p.items()})


def _windowed(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    starts, doc = windows_of(data, offsets)
    rows = gathered(data, starts, offsets[1:][doc])
    cut = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows)))
    wins = pa.array([rows[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), wins], names=["h", "lang", "windows"])


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """Learn from about `sample` labelled documents of each language, outside the held-out fold.

    The sample is chosen by a hash of the id; all windows of its documents reach the driver. Null
    texts aren't learned from. None if no document has a label.
    """
    rows = ids_only(docs, id=doc_id, text=text, lang=lang)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("id", HELD_OUT[0]) != HELD_OUT[1]))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    langs = sorted(counts)
    part = F.create_map(*(F.lit(x) for k in langs for x in (k, min(2**30, -(-sample * 2**20 // counts[k])))))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**20)) < part[F.col("lang")])
    got = map_arrow(chosen.select(F.xxhash64("id").alias("h"), "lang", "text"), _windowed, "h long, lang string, windows binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"], bytes(r["windows"])))
    if not got:
        return None
    x = np.frombuffer(b"".join(bytes(r["windows"]) for r in got), np.uint8).reshape(-1, LENGTH)
    doc = np.repeat(np.arange(len(got)), [len(r["windows"]) // LENGTH for r in got])
    return fitted(x, np.array([langs.index(r["lang"]) for r in got])[doc], doc, langs)


def _scorer(net: ByteNet, text: str):
    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = text_bytes(batch.column(text))
        starts, doc = windows_of(data, offsets)
        ends = offsets[1:][doc]
        sums = np.zeros((batch.num_rows, len(net.langs)))
        total = np.zeros(batch.num_rows)
        for s in range(0, len(doc), 64):
            cut = slice(s, s + 64)
            weight = np.clip(ends[cut] - starts[cut], 1, LENGTH).astype(float)
            p = net.probabilities(gathered(data, starts[cut], ends[cut])).astype(float)
            np.add.at(sums, doc[cut], p * weight[:, None])
            np.add.at(total, doc[cut], weight)
        mean = sums / np.maximum(total, 1)[:, None]
        best = mean.argmax(axis=1)
        letters = pc.match_substring_regex(batch.column(text).fill_null(""), "\\p{L}")
        langs = pc.if_else(letters, pa.array(net.langs).take(pa.array(best)), UNKNOWN)
        return [langs, pc.if_else(letters, pa.array(np.clip(mean[np.arange(len(best)), best], 0, 1)), 0.0)]

    return score


def with_language(docs: DataFrame, net: ByteNet | None, *, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of each whole text and its score.

    Overlapping windows of LENGTH bytes cover a text; the mean of their probabilities, weighted by
    their bytes, decides. A text that is null or without a letter is `und` with score 0, as is
    every text if there is no network. Every row stays, with its other columns, whatever its id;
    equal texts get equal answers. Columns that have the names `lang` or `score` are replaced.
    """
    if net is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    return with_arrow(docs, _scorer(net, text), f"`{lang}` string, `{score}` double", text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score")
