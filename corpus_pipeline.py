"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir), where docs was read from Parquet and
has the columns of the documents table, and works on all of its rows. The
stages but the last return those columns:

1. quality: rows that the Kneser-Ney model rejects go;
2. near_duplicates: of documents alike to 0.8 in 5-word shingles, linked
   directly or through others, the least doc_id stays;
3. decontaminate: documents that hold half of a benchmark item go;
4. pseudonymise: personal data is replaced within its format, n_chars follows;
5. mix: how many words the mixture takes from each document that is left.

The key of the pseudonyms is the session's spark.tessera.pii.key.

Empty tables give empty results. A filter takes rows, not ids: of rows that
share an id each goes by its own text. Rows without text pass the filters; a
row with a null id is judged by its text in the first, passes the others and
takes part in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import catalog, decontaminate, mixing, near, pii, quality
from tessera.llm.common import discard, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_in_place(docs, catalog.pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pseudonymise", pseudonymise_stage),
    ("mix", mix_stage),
]

#: SQL can't express the perplexities, the fingerprints and the keyed permutations; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
