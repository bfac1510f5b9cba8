"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import language, near_dedup, packing, substring_dedup, toxicity
from pixelweave.llm._common import fresh, staged, table

TOXIC = 0.5  # a document goes from this score on
SURE = 0.5  # a document goes if its language is less sure than this, or if it has none


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity scorer rejects. Each row is judged by its text alone, so null
    and empty texts, repeated rows and null ids are all judged alike; without labels all stay."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "_toxic")
    return toxicity.with_toxicity(docs, net, score=score).where(F.col(score) < TOXIC).select(docs.columns)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a sure language, null texts and texts without letters among them. Each
    row is judged by its text alone; if no document has a label, none is known and all go."""
    lang, score = fresh(docs, "_lang", "_sure")
    found = language.with_language(docs, language.train(docs), lang=lang, score=score)
    return found.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= SURE)).select(docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id.

    Of rows that repeat an id and its text one stays, the least in its columns' order, of those that repeat an id with similar texts
    one too. Rows with a null id, a null text or no words stay."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("id", "key").distinct()
    number, key, one = fresh(docs, "_id", "_key", "_one")
    keyed = docs.withColumns({number: F.col("doc_id"), key: F.unhex(F.md5(F.col("text").cast("binary")))})
    left = keyed.join(staged(gone).toDF(number, key), [number, key], "left_anti")
    known = F.col(number).isNotNull() & F.col(key).isNotNull()
    once = left.where(known).groupBy(number, key).agg(F.min(F.struct(*docs.columns)).alias(one)).select(f"{one}.*")
    return once.unionByName(left.where(~known).select(docs.columns))


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id holds too. Every row stays, null and empty texts
    as they are, and rows with a null id whole."""
    own = ("doc_id", "text", "n_chars")
    plain = docs.toDF(*(c if c in own else f"_{k}" for k, c in enumerate(docs.columns)))  # names that the operator's columns don't have
    left = substring_dedup.repeated_chunks(plain)
    chars = F.when(F.col("n_removed") > 0, F.length("text_left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns({"text": F.col("text_left"), "n_chars": chars}).select(plain.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens. Every row is packed; null and empty texts as one piece."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic_out),
    ("language_id", language_known),
    ("near_dedup", near_copies_out),
    ("substring_dedup", passages_out),
    ("packing", packed),
]

#: No stage has an SQL form; tests hold the stages against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
