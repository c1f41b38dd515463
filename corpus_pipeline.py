"""A corpus pipeline of the text operators: STAGES are applied one after the other, each result written and read again.

Toxic documents go, repeated lines are taken out, one document of each group of near-duplicates stays, documents that hold
passages of the benchmark go, and what is left is encoded. No SQL expresses the learned first stage, so there is none for
the whole; tests hold it against plain Python.

In every stage but the last, rows without doc_id stay unless the stage judges their own text (toxicity); null and empty texts
are kept, as they hold nothing to be rejected; rows that repeat a doc_id are kept or dropped together, except for toxicity and
lines, which judge each by its own text; an empty table stays empty; further columns pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontam, linededup, minhash, toxicity
from factweave.llm.common import settle, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go, whether or not they have a label."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines as in op5; n_chars follows the text."""
    done = linededup.dedup_lines(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 or more, the one with the least doc_id stays."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    return without(docs, settle(found.where("NOT kept").select("doc_id"), "duplicates"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of any benchmark item go."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, settle(found.where("doc_id IS NOT NULL").select("doc_id").distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs, f"stage{number}")
    return docs
