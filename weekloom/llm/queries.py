"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weekloom.llm import collocations, decontaminate, html_text, minhash, mixing, prefix_trie, quality, sanitise, substring, token_counts, toxicity, urls, vectors
from weekloom.session import workers_find_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(func: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        workers_find_package(spark)
        return func(spark, folder)

    QUERIES[func.__name__] = run
    return func


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_substring_dedup(spark, folder):
    return substring.repeated_spans(table(spark, folder, "documents", "doc_id", "text")).drop("spans")


@query
def op4_toxicity(spark, folder):
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    return toxicity.toxicity(table(spark, folder, "documents", "doc_id", "text"), labels)


@query
def op7_token_counts(spark, folder):
    import public_tokenizers

    path = public_tokenizers.path(token_counts.TOKENIZER)
    return token_counts.token_counts(table(spark, folder, "documents", "doc_id", "text"), path)


@query
def op8_quality(spark, folder):
    labels = table(spark, folder, "labels", "doc_id", "quality")
    return quality.quality(table(spark, folder, "documents", "doc_id", "text"), labels)


@query
def op5_minhash_dedup(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query
def op10_embedding_dedup(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op9_decontaminate(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark", "item_id", "text")).drop("most")
    return found.withColumn("item_ids", F.concat_ws(",", "item_ids"))


@query
def op2_source_mixing(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_url_filter(spark, folder):
    return urls.filtered(table(spark, folder, "pages", "page_id", "url")).drop("score")


@query
def op3_html_text(spark, folder):
    return html_text.extracted(table(spark, folder, "pages", "page_id", "url", "html"))


@query
def op11_sanitise(spark, folder):
    return sanitise.sanitised(table(spark, folder, "documents", "doc_id", "text"), texts=False)


@query
def op12_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents", "text", "lang")).drop("size")


@query
def op13_prefix_trie(spark, folder):
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(turns, prefix_trie.forked)


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
