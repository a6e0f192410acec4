"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.

Defined cases, for every stage: an empty table gives an empty one; columns
beyond those of documents stay as they are, whatever they are called; a null
text counts as the empty one; a null id is an id of its own that comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from sessionloom.llm.common import dropped, stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go.  Labels above 0 are toxic, others not, null ones none; too few of a kind: every document stays."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints, the one with the least id stays; repeated rows are one; empty texts are linked to each other."""
    return simhash.keep_one(docs)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings as long as a passage of 51 words (256 bytes) that occur elsewhere go; the document stays, even with nothing left."""
    return suffix_dedup.cleaned(docs, suffix_dedup.PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; a text without words too; the null source is a source."""
    return mixing.repeated(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit binary."""
    return bpe.tokenised(docs, *bpe.default_vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", cut_repeated),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", to_ids),
]

#: Trees, components and suffix sorting have no SQL; the tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's table is deleted when the next one is written, and the last one is the result."""
    docs, over = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before, over = over, []
        docs = stored(stage(spark, docs, sf_dir), name, over)
        dropped(before)
    return docs
