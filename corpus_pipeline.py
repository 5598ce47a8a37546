"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of docs; the last adds the pieces.

All stages take empty tables, nulls in any column, and further columns, whose names may clash with the operators' own.
Where a stage keeps a document, it keeps all its rows, but for near_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fresh_name, staged, table
from quillspark.llm.op1_language_id import keep_identified
from quillspark.llm.op2_sentencepiece import round_trip
from quillspark.llm.op4_secrets import redact
from quillspark.llm.op6_decontaminate import remove_leaking
from quillspark.llm.op8_simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or unlike every learned language, go. Repeated rows are judged alike."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest key's, null keys first; of one key's texts, the smallest hash's; of
    repeated rows, one. Texts without a word are one group."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within the allowed edits, go, each row by itself. Null texts and items match nothing."""
    return remove_leaking(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, overlapping ones by one mask, and n_chars is counted anew; every document stays. Null texts stay null."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the sampled pieces and their number, under names that are free; the text is what the pieces decode to. A null text
    has null pieces; equal keys and texts have equal pieces."""
    made = round_trip(docs)
    ids, back = made.columns[-2:]
    return made.select(*[F.col(back).alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(ids).alias(fresh_name(docs, "piece_ids")), F.size(ids).cast("long").alias(fresh_name(docs, "n_pieces")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("encode", encode),
]

#: SQL can express neither the models nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
