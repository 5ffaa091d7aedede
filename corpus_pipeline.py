"""The corpus pipeline: stages that each call an operator of lakewright.llm, applied to a table of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. run() writes each stage's result
as Parquet to the shared folder and reads it again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.llm.common import Scratch
from lakewright.llm.decontaminate import decontaminate
from lakewright.llm.minhash_dedup import one_of_each_group
from lakewright.llm.packing import pack
from lakewright.llm.pii import mask_pii
from lakewright.llm.queries import table, tokenizer_path
from lakewright.llm.toxicity import toxicity, train_toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on labelled rows of docs, does not call toxic."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, threshold=0.7).where(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each_group(docs, words_per_shingle=5, per_cent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows where it is a column."""
    out = mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_documents),
]

#: A trained model, MinHash groups, edit distances and a tokenizer are beyond SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
