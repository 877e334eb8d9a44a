"""The opN_ queries: thin wrappers of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respira.llm import flac, hardnegatives, htmltext, linededup, mixing, ngramjoin, packing, quality, rules, secrets, sharding, sql, toxicity, turntrie
from respira.llm.common import table
from respira.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_mix_sources", sql.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, source, n_tokens, epoch, block, position."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@REGISTRY.query("op2_host_rules", sql.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


@REGISTRY.query("op3_ngram_jaccard", sql.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's three words and 90 percent."""
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


@REGISTRY.query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


@REGISTRY.query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@REGISTRY.query("op6_flac_media")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


@REGISTRY.query("op7_line_dedup", sql.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@REGISTRY.query("op8_pack")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("copy")


@REGISTRY.query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op10_cotrained_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@REGISTRY.query("op11_turn_trie", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.family_trie(table(spark, sf_dir, "conversations"))


@REGISTRY.query("op12_shards")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: rounds of moves under quotas; tested against counts, cut links and the best cut of small cases."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


@REGISTRY.query("op13_hard_negatives", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.mined(table(spark, sf_dir, "embeddings"))
