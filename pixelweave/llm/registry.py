"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import chat_format, structure_repair
from pixelweave.llm.chat_format import op12_chat_format
from pixelweave.llm.embedding_dedup import op8_embedding_dedup
from pixelweave.llm.language import op1_language_id
from pixelweave.llm.near_dedup import op5_near_dedup
from pixelweave.llm.neighbours import op9_neighbours
from pixelweave.llm.packing import op3_packing
from pixelweave.llm.sentencepiece_bpe import op6_sentencepiece
from pixelweave.llm.sharding import op7_sharding
from pixelweave.llm.structure_repair import op11_structure_repair
from pixelweave.llm.substring_dedup import op4_substring_dedup
from pixelweave.llm.suffix_dedup import op2_suffix_dedup
from pixelweave.llm.toxicity import op10_toxicity
from pixelweave.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_sharding": op7_sharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_neighbours": op9_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_structure_repair": op11_structure_repair,
    "op12_chat_format": op12_chat_format,
    "op13_whitening": op13_whitening,
}

#: The other methods have no SQL form. Tests hold them against brute force, a library, or held-out labels.
ORACLE_SQL: dict[str, str] = {"op11_structure_repair": structure_repair.ORACLE_SQL, "op12_chat_format": chat_format.ORACLE_SQL}
