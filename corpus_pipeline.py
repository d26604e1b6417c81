"""The training-corpus pipeline: stages from ``documents`` to token ids.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` writes every stage's
result to the shared folder and reads it again as the next stage's ``docs``. In all
stages rows with a null id or text and empty texts pass through (a text without an id is
still judged for what it holds), repeated rows share one fate, an empty table stays
empty, and columns besides doc_id, text and n_chars are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentionary.llm import bpe, decontam, near_dup, pii, toxicity
from mentionary.llm.queries import VOCABULARY, table
from mentionary.llm.scratch import discard, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier, trained on the labels, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    return near_dup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, even edited."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its label."""
    return pii.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_texts(docs, VOCABULARY)


STAGES = [
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("PII", redact_personal),
    ("BPE encoding and decoding", tokenise),
]
#: SQL can't express these stages (trained models, approximate search, alignment); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
