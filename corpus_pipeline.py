"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the docs of the next. All but the last
return the columns of ``documents``; ``n_chars`` follows a text that a stage changes.

Toxicity drops the documents that it rejects. Line dedup cuts repeated passages and drops
documents of which nothing else is left. SimHash near-dedup keeps the document of the
least id of each group. The secret scan puts the kind of a secret in its place. Packing
turns the rest into sequences of tokens: a row per piece with its place.

Defined results, each stage as its operator has it: a null text stays null through the
text stages and is one end token in a sequence; empty texts and very long ones are
treated whole; of rows that repeat an id with equal text one stays; rows without an id
stay; equal texts under several ids leave the one of least id; an empty table gives an
empty table; extra columns pass through all stages but the last, which has none of them.

Whole texts go to the workers in small batches (``common.lean``), for an executor that
runs all five stages one after the other keeps the largest buffers that any of them took.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.llm import linededup, packing, secrets, simhash, toxicity
from readyscope.llm.common import columns_of, lean, read_table, stored, unused
from readyscope.llm.registry import tokenizer_path, with_workers

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    if not {"text", "n_chars"} <= set(docs.columns):
        return docs
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.coalesce(count, F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(lean(docs), read_table(spark, sf_dir, "labels"))
    severity = unused(docs, "severity")
    rated = toxicity.with_severity(docs, model, column=severity)
    return rated.where(F.col(severity) < model.rejected_from).select(*columns_of(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.drop_repeats(lean(docs)))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(lean(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.without_secrets(lean(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(lean(docs), tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# Models, hashes and tokenizers have no SQL; the tests hold each stage to a plain version
ORACLE_SQL = None


@with_workers
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
