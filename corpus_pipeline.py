"""The corpus pipeline: quality, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
SQL can't express the stages, so ``ORACLE_SQL`` is None and tests hold the
pipeline against brute force.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, an empty table and columns of any name; what it makes of them is said
with it.
"""

from __future__ import annotations

from spindrift.llm import exact_dedup, near_dedup, packing, pii, quality
from spindrift.llm.common import stage
from spindrift.llm.queries import tokenizer


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts.

    A null or empty text is judged as one empty line, a null id as any other; equal texts share their verdict;
    without labels of both kinds the share of good ones decides for all; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark, docs, sf_dir):
    """One document of those with equal normalised text: the longest, then the smallest id.

    A null text equals an empty one; a null id comes last; of rows that repeat in full one stays; an empty table stays empty."""
    return exact_dedup.keep_first(docs)


def drop_near(spark, docs, sf_dir):
    """One document of each group of near-duplicates: that with the smallest id.

    Texts without words are linked with nothing and stay; rows without id all stay; rows of one id are judged each by
    their own text, and of those that repeat in full one stays; an empty table stays empty."""
    return near_dedup.keep_one(docs)


def mask_personal(spark, docs, sf_dir):
    """The documents with personal data masked; n_chars stays what it was before.

    A null text stays null; every row stays, whatever its id; equal texts are masked alike; an empty table stays empty."""
    return pii.redact(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents with their ids and places in the training sequences.

    A null or empty text is the end id alone; a longer text than a sequence is cut; rows that repeat are packed as
    often as they occur; other columns than the id are left behind; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("pii", mask_personal), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
