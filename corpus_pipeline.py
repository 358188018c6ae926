"""A training-data pipeline over `documents`: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of docs.
A stage's docs are a written table. Rows with null columns, empty texts, repeated rows and empty tables follow the rules stated by
each operator; texts without a letter have no language and are rejected by the first stage. Extra columns come out as they went in,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, minhash, packing, pii, quality
from quillspark.llm.common import id_text, judged, read, table

#: A document is rejected if its language is unknown or its posterior is below this.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents are near-duplicates if their sets of word shingles have this similarity in percent, or a chain of such links.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    known = f"lang_pred != '{langid.UNKNOWN}' and score >= {LEAST_LANGUAGE_SCORE}"
    return judged(docs, lambda d: langid.predict(d, model), ["lang_pred", "score"], known)


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(F.crc32(id_text()) % 5 != 0))
    return judged(docs, lambda d: quality.predict(d, model), ["score", "predicted"], "predicted = 1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(docs, NEAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", good_text),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Trained models and tokenizers have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
