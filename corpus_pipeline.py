"""From raw documents to training tokens: five stages, each over all that the one before it kept.

Defined cases, stage by stage.  Quality rules: a null text has no words and goes; a null language is a stratum of its own; documents without
labels are judged by the cutoffs of their language.  Jaccard join: rows alike in id and text are one; texts without words
stay; a null id is last in order.  Substring dedup: a text that loses nothing stays as it is, a text that loses all its words stays as an empty one.
Mix: texts without words go; a document stands as often as its source's target asks, at most three times for each of its rows; a null source is a
source.  Tokens: a null text has no tokens.  An empty table stays empty in every stage; extra columns are kept by all stages but the last.

Scale: see the operators; texts are shuffled by document in the Jaccard join, the dedup and the mix, and never grouped by a shared key.  Each stage is written
to the shared folder, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticore.llm import bpe_fst, mixing, parity_join, quality, substring_dedup
from latticore.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified rule reject go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return parity_join.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return substring_dedup.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    coded = bpe_fst.encode(docs, *bpe_fst.public_vocabulary(), decoded="decoded")
    return coded.select("doc_id", "lang", "source", "ids", *(v.alias(k) for k, v in bpe_fst.digests(coded).items()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
