"""The queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import chat_format as chat
from gridspark.llm import compression_quality as quality
from gridspark.llm import decontaminate as leaks
from gridspark.llm import line_dedup as lines
from gridspark.llm import mixing
from gridspark.llm import prefix_trie as trie
from gridspark.llm import quality_rules as rules
from gridspark.llm import secret_scan as secrets
from gridspark.llm import simhash
from gridspark.llm import span_dedup as repeats
from gridspark.llm import token_count as tokens
from gridspark.llm import vector_codes as vectors
from gridspark.llm import warc
from gridspark.llm.common import table
from gridspark.sources.tables import spread

VOCABULARY = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = rules.fit_line_crf(docs, table(spark, sf_dir, "labels"))
    return rules.quality_rules(docs, model, carry=["doc_id"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_size_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_fold(quality.quality_scores(docs, model, carry=["doc_id"]))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digest(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, mixing.source_rates(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), VOCABULARY, carry=["doc_id"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.containment_matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.span_report(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spread(table(spark, sf_dir, "pages")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_report(spread(table(spark, sf_dir, "embeddings")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_simhash,
        op3_line_dedup,
        op4_compression_quality,
        op5_chat_format,
        op6_secret_scan,
        op7_mixing,
        op8_token_counts,
        op9_decontaminate,
        op10_span_dedup,
        op11_warc,
        op12_vector_codes,
        op13_prefix_trie,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_decontaminate": leaks.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_vector_codes": vectors.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
