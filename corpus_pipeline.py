"""The corpus pipeline: documents go through the stages in order, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last one adds what the mix takes. In every stage an empty
table gives no rows, rows alike in id and text are treated alike, and other columns stay; what nulls do is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscribe.llm import decontamination, jaccard, language_id, mixing, pii
from gridscribe.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, learnt from the labelled ones, recognises; null texts and texts without a letter go."""
    named = language_id.identify(docs, language_id.fit(docs))
    return named.where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more link: the least id, null ids last; of rows alike in id and text one stays. Texts without a word stay."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, to 0.8 of its shingles or more; null texts contain none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it taken out of their texts; a null text stays null."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many complete passes and how many words in all; null sources are one source, null texts have no words and go."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("pii", personal_data), ("mixing", mix)]
#: Learnt models and rewritten texts are not SQL; tests hold each stage's operator against brute force, and the chain against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
