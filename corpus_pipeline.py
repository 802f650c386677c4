"""Five stages that turn raw documents into packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontamination, packing, secrets, simhash, toxicity
from lectern.llm.common import table
from lectern.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Learned models and hashes decide, which SQL cannot express.
ORACLE_SQL = None


def flag_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; documents whose id is null are judged like any other."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id."""
    return simhash.one_of_each(docs.select(*COLUMNS), width=5, similarity=0.8)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's five-word shingles go."""
    return decontamination.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    model = secrets.fit(docs)
    return secrets.redacted(docs.select(*COLUMNS), model, by="[secret]").withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("toxicity", flag_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaked),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
