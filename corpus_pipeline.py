"""The corpus pipeline: documents in, encoded training documents out.

Quality classifier, near-duplicate removal, secret redaction, source mixing, byte-level BPE. Each stage takes
(spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents, the last one digests.

In every stage, further columns ride along whatever their names, and an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basaltic.llm import bpe_codec, chosen_paths, rule_ensemble, secrets, source_mix
from basaltic.llm.common import stored
from basaltic.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; the rest go. Null and empty texts are scored as texts without words, null ids
    like others; repeated rows share one verdict. Without usable labels all score one half and stay."""
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.accepted(docs, model, threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, a similarity of 0.8 or more. Texts
    of fewer words count as one shingle, those without words and null ones are nobody's copy. Rows with a null id stay; rows
    that repeat one id stay or go together."""
    return chosen_paths.deduplicated(docs, words=5, percent=80)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; of overlapping secrets the first names the kind. Null texts stay null,
    repeated rows are treated alike."""
    return secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts have no words and are never taken; null sources are one
    source; rows of one id, null included, are taken equally often."""
    return source_mix.mixed(docs, most_times=3)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to. The memory of pieces is small here, for workers of earlier stages may
    still stand by. A null text counts as empty, with no tokens and the digests of nothing; repeated rows each get a row."""
    return bpe_codec.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=100_000)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("secret_scans", secret_redaction),
    ("source_mixing", mixing),
    ("byte_bpe", encoding),
]

#: SQL can't express the fitted classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor kept; all but the last are written and read again. Nulls, empty
    texts, repeated rows and empty tables are as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
