"""The queries opN_<name>: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licences, merkle, mixing, quality, rules, secret_scan, simhash, tokenfiles, trie, url_filter
from .common import crc_mod, materialize, table
from .oracles import ORACLES  # noqa: F401  SQL for those that SQL can express; the others are tested against brute-force versions in tests/llm


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, crc_mod(F.col("doc_id"), 4) == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels, crc_mod(F.col("doc_id"), 3) == 1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return rules.judged(docs, labels)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = pages.join(bad, pages.page_id == bad.doc_id).select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    return url_filter.judge(pages, labelled)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, names = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = secret_scan.find(materialize(scanned.drop("text")), names)
    n = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op11_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return tokenfiles.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(vocabulary))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.proofs(table(spark, sf_dir, "documents").select(*merkle.FIELDS), merkle.tampered(F.col("doc_id")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_quality_rules, op4_license_scan, op5_chat_formatting,
        op6_url_filter, op7_decontamination, op8_simhash, op9_mixing, op10_secret_scan,
        op11_token_ids, op12_merkle_manifest, op13_prefix_trie,
    )
}
