"""From raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontamination, minhash, packing, pii, quality
from geoloom.llm.queries import pii_key
from geoloom.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; each row is judged by its text, whatever its doc_id."""
    return quality.passable(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: of its lowest doc_id, or a null one where there are no others."""
    row = lambda doc_id, digest: F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.hex(digest)).cast("binary"))
    told = minhash.near_duplicates(docs).where("keep")
    kept = told.select(row(told["doc_id"], told["text_md5"]).alias("__row")).distinct()
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    own = docs.select(*COLUMNS, row(docs["doc_id"], digest).alias("__row"))
    return own.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged by its text, whatever its doc_id."""
    return decontamination.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by pseudonyms; n_chars is that of the new text."""
    out = pii.pseudonymize(docs.select(COLUMNS), pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", decontaminate),
    ("PII", pseudonymize),
    ("packing", pack),
]

#: No SQL: weights come from matrix factors, samples from hashes, tokens from a tokenizer. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
