"""From raw documents to token ids: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import bpe, decontaminate, near_dup, suffix_dedup, toxicity
from tabscope.llm.common import read_table, stored
from tabscope.llm.queries import learnt_labels, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit_on(docs, learnt_labels(spark, sf_dir)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return near_dup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 400-byte string that starts anywhere else are cut out of the texts, and so are passages of 50
    words or more that stand in different documents; all rows stay."""
    return suffix_dedup.drop_repeats(docs, words=suffix_dedup.WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("repeated passages", without_repeats),
    ("benchmark passages", without_benchmark),
    ("token ids", as_tokens),
]

#: SQL has no zstandard dictionaries and no tokenizer; the tests check every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each of them keeps is written and read again for the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
