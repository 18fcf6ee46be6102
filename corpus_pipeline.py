"""The corpus pipeline: toxicity, quality rules, line dedup, near-dedup, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
documents: the first two and the fourth drop rows, the third rewrites texts
(and drops documents of which nothing is left). The last returns a row for each
piece of a document with its sequence and offset.

The last stage's token ids come from a tokenizer, so no SQL can give its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import bpe, linedup, neardup, packing, quality, toxicity
from moraine.llm.common import keep, table


#: Words that a worker of the last stage keeps; it has the other stages' memory beside it.
WORDS_KEPT = 50_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.keep_first_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, 5, 80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, bpe.default_path(), cache=WORDS_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
