"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnstide.llm import oracle
from dnstide.llm.byte_bpe import bpe_decode, bpe_encode
from dnstide.llm.decontaminate import contamination
from dnstide.llm.embedding_dedup import embedding_dedup
from dnstide.llm.filter_audit import filter_masks, interactions
from dnstide.llm.langid import held_out, identify, train
from dnstide.llm.line_dedup import line_dedup
from dnstide.llm.packing import pack
from dnstide.llm.pii import KINDS, NAMES, replace_pii
from dnstide.llm.secrets import BASE, RULES, scan, spelled
from dnstide.llm.shared import table
from dnstide.llm.simhash import hex16, simhash_components
from dnstide.llm.suffix_dedup import substring_dedup
from dnstide.llm.url_filter import SOFT, SOFT_LIMIT, STRICT, url_filter
from dnstide.llm.vector_codes import compress, hex_code


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_pii(table(spark, sf_dir, "documents"), key="op4")
    return found.select("row.doc_id", "text", *(F.col("entities")[k].alias(f"n_{k}") for k in (*KINDS, *NAMES)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rule"] < BASE)
    count = lambda i: F.size(F.filter("spans", lambda x: x["rule"] == i)).cast("bigint")
    return found.select("doc_id", *(count(i).alias(f"n_{RULES[i].kind}") for i in range(BASE)), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(filter_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    found = bpe_decode(encoded, ranks, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join("ids", ","), 256)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", hex_code(F.col("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_packing, op3_suffix_dedup, op4_pii_surrogates, op5_secret_scan, op6_embedding_dedup, op7_language_id, op8_line_dedup, op9_url_filter, op10_simhash, op11_filter_audit, op12_byte_bpe, op13_vector_codes)}

ORACLES = {
    "op1_decontaminate": oracle.CONTAMINATION,
    "op5_secret_scan": oracle.secret_scan_sql(RULES, BASE),
    "op6_embedding_dedup": oracle.EMBEDDING_DEDUP,
    "op8_line_dedup": oracle.LINE_DEDUP,
    "op9_url_filter": oracle.url_filter_sql(STRICT, SOFT, SOFT_LIMIT),
    "op11_filter_audit": oracle.FILTER_AUDIT,
    "op13_vector_codes": oracle.vector_codes_sql(),
}
