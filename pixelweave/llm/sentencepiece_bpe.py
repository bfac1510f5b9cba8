"""SentencePiece BPE encoding from a table of prefixes' last tokens, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import ids_only, map_arrow, table

SPACE = "▁"
CACHE = 600_000  # encoded words that a worker keeps
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PrefixBpe:
    """Encoder and decoder for a BPE model with byte fallback, a dummy prefix and no other normalization.

    Such a model merges, again and again, the adjacent pair that makes the best piece, the leftmost
    of equals. So the encoding of a prefix ends in exactly one token: the one that ends there and
    is compatible with the last token of the prefix before it, which means that the two, encoded
    together, stay apart. Going through the text, an automaton names the tokens that end at each
    position, and a table keeps the last token of each prefix; the ids follow backwards from its end.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(self.byte) != 256 or sp.encode("a  b", out_type=str)[0][0] != SPACE:
            raise ValueError("the model must have byte fallback and a dummy prefix")
        self.id = {self.piece[i]: i for i in plain}
        self.score = [sp.get_score(i) for i in range(n)]
        long = sorted((i for i in plain if len(self.piece[i]) > 1), key=lambda i: -self.score[i])
        self.rank = [-1] * n  # of merges; a single character has none
        for r, i in enumerate(long):
            self.rank[i] = r
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.near = set()  # pairs of characters that a piece can hold side by side
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            p = self.piece[i]
            self.near.update(p[k : k + 2] for k in range(len(p) - 1))
            if len(p) > 1:
                ids, last = self.merged(p)
                if ids != [i]:
                    continue  # no text is ever encoded to it
                self.parts[i] = last
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def merged(self, s: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids of a short text by merging pairs from a heap, and the parts of the last merge.
        It says how pieces come about, and serves runs of spaces, whose pieces have equal scores."""
        sym: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, sym[a], sym[b]))

        for a in range(len(s) - 1):
            offer(a, a + 1)
        last = None
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a]
            if sym[a] != x or b < 0 or sym[b] != y:
                continue
            last = (self.id.get(x, -1), self.id.get(y, -1))
            sym[a], sym[b] = x + y, None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        ids: list[int] = []
        for x in sym:
            if x is not None:
                ids += [self.id[x]] if x in self.id else [self.byte[k] for k in x.encode()]
        return ids, last

    def compatible(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens stay apart: going back in time, no pair at their border
        would have merged before the merges that took its members."""
        limit = len(self.piece)
        while True:
            c = self.id.get(self.piece[a] + self.piece[b])
            if c is not None and self.rank[c] < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.parts[a][1]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.parts[b][0]
            else:
                return True

    def atom(self, s: str) -> list[int]:
        """Ids of a text without two spaces in a row, from the table of prefixes' last tokens."""
        last: list[int] = [-1] * len(s)  # -1: the character has no piece and is spelled in bytes
        fits = self.fits
        for end, (length, token) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0 and (a := last[before]) >= 0:
                key = a << 20 | token
                ok = fits.get(key)
                if ok is None:
                    ok = fits[key] = self.compatible(a, token)
                if not ok:
                    continue
            last[end] = token
        ids: list[int] = []
        at = len(s) - 1
        while at >= 0:
            if (token := last[at]) >= 0:
                ids.append(token)
                at -= len(self.piece[token])
            else:
                ids += [self.byte[k] for k in reversed(s[at].encode())]
                at -= 1
        ids.reverse()
        return ids

    def word(self, s: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and the decoded text of a word with its leading spaces."""
        found = self.words.get(s)
        if found is None:
            if s.startswith(SPACE * 2):
                ids = self.merged(s)[0]
            else:  # no piece spans characters that never stand side by side in one
                ids, begin = [], 0
                for k in range(1, len(s) + 1):
                    if k == len(s) or s[k - 1 : k + 1] not in self.near:
                        ids += self.atom(s[begin:k])
                        begin = k
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(self.fits) >= 8 * CACHE:
                self.fits.clear()
            found = self.words[s] = (len(ids), ",".join(map(str, ids)), self.decoded(ids))
        return found

    def decoded(self, ids: list[int]) -> str:
        """Text of ids; runs of byte tokens are UTF-8, spaces are restored."""
        out = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                out.append(b)
            else:
                out += self.piece[i].replace(SPACE, " ").encode()
        return out.decode("utf-8", "replace")

    def split(self, text: str) -> list[str]:
        """Words with their leading spaces: no piece holds a space after another character."""
        if not text:
            return []
        if SPACE not in text:
            parts = text.split(" ")
            if "" not in parts[:-1]:
                return [SPACE + p for p in parts]
        return _RUNS.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.split(text) for i in self.word(w)[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids)[1:] if ids and self.piece[ids[0]].startswith(SPACE) else self.decoded(ids)


@lru_cache(maxsize=1)
def codec(model_file: str) -> PrefixBpe:
    return PrefixBpe(model_file)


def _coder(model_file: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, out = codec(model_file), []
        for text in batch.column("text").to_pylist():
            words = [bpe.word(w) for w in bpe.split(text or "")]
            ids = ",".join([w[1] for w in words])
            back = "".join([w[2] for w in words])[1:]  # without the dummy prefix
            out.append((sum(w[0] for w in words), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        n, a, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n", "ids", "back"])

    return run


def coded(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """Encode each whole text as the sentencepiece library does, and decode the ids again.

    Returns id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 for
    every row, also for null and repeated ids; null texts count as empty and give no ids, and an
    empty table no rows. Words repeat, so workers keep up to
    CACHE encoded words; `PrefixBpe` gives the ids and texts themselves.
    """
    import public_tokenizers

    rows = ids_only(docs, id=doc_id, text=text)
    run = _coder(model_file or public_tokenizers.path("piece_bpe_32k.model"))
    found = map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, n long, ids string, back string")
    return found.select("id", F.col("n").alias("n_tokens"), F.col("ids").alias("ids_sha256"), F.col("back").alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the text they decode to."""
    return coded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
