"""From raw documents to packed training sequences: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import minhash, mixing, packing, substrings, toxicity
from lumenfold.llm.common import discard_since, materialise, table, written

#: The rule for stages on word shingles; the 0.85 of op10's contract holds for its query only.
NEAR = (80, 100)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    A null text is scored as an empty one, a row without id like any other; repeated rows go or stay together.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one document stays; they are linked at a shingle similarity of NEAR or more.

    The smallest doc_id stays, a row without id only where its group has no other; of repeated rows one stays. Null and
    blank texts are groups of their own and stay.
    """
    return minhash.keep_one(docs, NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are cut out of all texts.

    No row goes: a text that is all repeats becomes empty, a null text stays null, a text under 200 bytes as it is.
    """
    return substrings.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document that the mix takes twice is there twice.

    A null source is the last one; a null or blank text has no words and passes at most as often as its source; ties in
    finish time are in the order of the rows' digests.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids' digests; a null or empty text is the one id that ends a document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", minhash_stage),
    ("suffix_array_dedup", substring_stage),
    ("mix_sources", mixing_stage),
    ("pack_sequences", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared scratch folder before the next stage reads it.

    What a stage wrote besides its result is removed with the stage's input, once the result is stored.
    """
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        discard_since(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
