"""Registered queries of the pipeline operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm import (
    bpe, class_lm, fingerprints, line_crf, line_dedup, mixing, ngram_join, pii, prefix_trie, quality_rules, secret_scan,
    token_alignment, window_dedup)
from quillgraph.llm.oracles import ORACLES as ORACLES
from quillgraph.llm.textkit import spread
from quillgraph.session import tune

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PII_KEY = "demonstration key; a production run reads its own from a secret store"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str) -> Callable:
    def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        return build

    return add


def _sha(value: Column) -> Column:
    return F.sha2(value, 256)


@query("op1_bpe")
def op1(read) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = spread(read("documents").select("doc_id", "text"))
    tokens = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return tokens.select(
        "doc_id", bpe.token_count(F.col("token_ids")).alias("n_tokens"), _sha(F.col("token_ids")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"))


@query("op2_fingerprints")
def op2(read) -> DataFrame:
    return fingerprints.edited_pairs(read("documents"))


@query("op3_quality_rules")
def op3(read) -> DataFrame:
    return quality_rules.apply_rules(read("documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_secrets")
def op4(read) -> DataFrame:
    found = secret_scan.find_secrets(spread(read("documents").select("doc_id", "text"))).drop("text")
    base = [r.kind for r in secret_scan.BASE]
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[of(k) for k in base],
        _sha(secret_scan.spans_text(F.filter("secrets", lambda s: s["kind"].isin(base)))).alias("base_sha256"),
        secret_scan.spans_text(F.col("secrets")).alias("spans"))


@query("op5_mixing")
def op5(read) -> DataFrame:
    return mixing.mix(read("documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op6_pii")
def op6(read) -> DataFrame:
    return pii.pseudonymise(read("documents").select("doc_id", "text"), PII_KEY)


@query("op7_line_dedup")
def op7(read) -> DataFrame:
    return line_dedup.dedup_lines(read("documents").select("doc_id", "text"))


@query("op8_ngram_join")
def op8(read) -> DataFrame:
    return ngram_join.components(read("documents").select("doc_id", "text"), size=4, percent=85)


@query("op9_window_dedup")
def op9(read) -> DataFrame:
    kept = window_dedup.remove_repeats(read("documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha(F.col("text")).alias("kept_sha256"))


@query("op10_line_crf")
def op10(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text")
    model = line_crf.fit(docs, read("labels"))
    return line_crf.score(docs, model).select(
        "doc_id", (line_crf.fold(F.col("doc_id")) == line_crf.HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= line_crf.CUT).cast("int").alias("predicted"))


@query("op11_class_lm")
def op11(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text")
    return class_lm.score(docs, class_lm.fit(docs.filter(~class_lm.held_out(F.col("doc_id")))))


@query("op12_prefix_trie")
def op12(read) -> DataFrame:
    return prefix_trie.prefix_nodes(read("conversations"))


@query("op13_token_alignment")
def op13(read) -> DataFrame:
    aligned = token_alignment.align(
        read("documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES), groups="sha256")
    return aligned.withColumnRenamed("groups", "groups_sha256")
