"""The thin queries of this subpackage, one for each operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basaltic.llm import bpe_codec, cap_filters, chosen_paths, licenses, line_rules, packed_ids, rule_ensemble, secrets, source_mix, token_counts
from basaltic.llm.oracles import SQL
from basaltic.sources.tables import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the compiled transducer."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality counts and cross-document line frequency; the host of a document is its source."""
    return line_rules.line_frequency(table(spark, sf_dir, "documents"), min_docs=10, min_share=0.1, min_left=0.5)


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, written and read back."""
    return packed_ids.packed(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _pattern(), end_id=0)


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a model fitted on a bounded sample of labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.scored(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding of every document."""
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op8_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents over two-word shingles."""
    return chosen_paths.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return source_mix.mix(table(spark, sf_dir, "documents"), most_times=3)


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings of equal label."""
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_line_frequency": op2_line_frequency,
        "op3_packed_ids": op3_packed_ids,
        "op4_rule_ensemble": op4_rule_ensemble,
        "op5_license_scan": op5_license_scan,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_secret_scan": op7_secret_scan,
        "op8_chosen_paths": op8_chosen_paths,
        "op9_source_mix": op9_source_mix,
        "op10_cap_filters": op10_cap_filters,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers, fuzzy matching and the fitted model have none; tests hold them against libraries and brute force."""
    return dict(SQL)
