"""The corpus pipeline: five of the training-data operators, one after another, each over all that its predecessor kept.

Defined cases, for every stage: null and empty texts stay (and are one piece of
the closing id in the end), as do rows without an id; very long texts are taken
whole; an empty table gives an empty result; further columns are kept up to the
packing stage. Rows that repeat an id are equal rows: one stays after the near
copies. Ties go to the smallest id, then the first line. The line stage cuts
what near copies share, so hardly any are left for the stage after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshrel.llm import line_dedup, minhash_dedup, packing, substring_dedup, toxicity_cnn
from meshrel.llm.tables import save, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_cnn.drop_toxic(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, go from the texts."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of ``WINDOW`` words or more that an earlier document has go from the texts."""
    return substring_dedup.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("minhash_dedup", near_copies), ("substring_dedup", substrings), ("best_fit_packing", pack)]

#: No SQL can express the classifier, the tokenizer or the packing program; tests/llm/test_pipeline.py holds each stage against a brute-force version on a fixture (the first against its classifier).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
