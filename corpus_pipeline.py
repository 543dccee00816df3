"""The corpus pipeline: quality rules, near-duplicate groups, repeated passages,
benchmark passages, token ids. Each stage works on all its predecessor kept.

A stage decides about a row by its doc_id and its text, so rows without id, and rows that
repeat an id with another text, stand for themselves. Columns beside doc_id, text, lang
and n_chars can have any name and pass through all stages but the last.
"""

from __future__ import annotations

from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.bpe_fst import encoded
from lodestrata.llm.common import drop_stashes, made, stash, table
from lodestrata.llm.decontaminate import clean_rows
from lodestrata.llm.partenum_join import first_rows
from lodestrata.llm.quality import kept_rows
from lodestrata.llm.suffix_dedup import deduplicated_rows

#: The iterated statistics of the stages can't be put in SQL; the tests hold them against brute force.
ORACLE_SQL = None
#: What the stage before wrote on its way, in this thread of work.
_before: ContextVar[tuple[str, ...]] = ContextVar("before", default=())


def staged(stage):
    """A stage's result is written before the next stage is called, so what a stage wrote on its way goes then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stashes(spark, list(_before.get()))
        known = set(made())
        df = stage(spark, docs, sf_dir)
        _before.set(tuple(p for p in made() if p not in known))
        return df

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the divergence from their language reject go; null texts have no words and go."""
    return kept_rows(spark, docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more the row with the smallest doc_id
    stays; rows without id come last, and of rows equal in id and text one stays."""
    return first_rows(spark, docs, width=5, percent=80)


@staged
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text loses the bytes of 50-byte strings that start in a document of smaller doc_id; a text can become empty, and
    n_chars is counted anew where it changed."""
    return deduplicated_rows(spark, docs)


@staged
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a test item's question and answer go, with or without id."""
    return clean_rows(spark, docs, table(spark, sf_dir, "benchmark"))


@staged
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, their digest, and that of the decoded bytes; a null text has none."""
    import public_tokenizers

    return encoded(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(spark, docs, name.replace(" ", "-"))
            if written:
                drop_stashes(spark, [written])
            written = made()[-1]
    return docs
