"""A corpus pipeline: five stages, each over all that the stage before it kept.

Toxic documents go, one document of each group of near copies stays, passages
that repeat are cut out, sources are mixed to their target shares, and what is
left is tokenised and packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from tellura.llm.common import materialise, spare, table

#: Documents of at least this score go.
TOXIC = 0.3
#: Near copies: five-word shingles, Jaccard similarity of at least 0.8.
NEAR = ngram_join.Likeness(words=5, num=80, den=100)
#: Words of a passage that may not stand in two places.
PASSAGE = 50
SEQUENCE = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; learnt from the labels of those that are there.

    Null and empty texts have the score of no evidence; rows that repeat fare
    alike; columns keep their values, whatever their names; an empty table gives
    an empty one.
    """
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), spare(docs.columns, "_score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; of rows that repeat id and text, one; see first_documents()."""
    return ngram_join.first_documents(docs, NEAR)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in two places; a document of which nothing is left goes; see remove_repeats()."""
    return substring_dedup.remove_repeats(docs, PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to the sources' target shares, in a global shuffle; see replicate().

    Columns that have the names of its figures go on as they came.
    """
    taken = {"_copy", "_rate", "_shuffle_key"}
    own = {c: spare(docs.columns, f"_own{c}") for c in docs.columns if c.lower() in taken}
    mixed = mixing.replicate(docs.withColumnsRenamed(own))
    return mixed.drop(*taken).withColumnsRenamed({v: k for k, v in own.items()})


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, with their sequences and places there; see pack_documents() for null, empty, long and repeated texts."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("substring_dedup", cut_repeats), ("source_mixing", mix_sources), ("packing", pack)]

#: Classifiers, tokens and packing can't be said in SQL: tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
