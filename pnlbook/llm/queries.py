"""One query per numbered operator: (spark, sf_dir) -> DataFrame, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pnlbook.session import scratch_dir

from . import cover, interactions, neighbours, packing, partenum, pieces, pii, rules, sharding, suffixes, turntrie, urlrules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by bytes."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_dir(spark, "slot-map"))
    return out.select("doc_id", *sharding.RESULT)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under four-word shingle similarity of 0.85."""
    return partenum.components_of(table(spark, sf_dir, "documents"), gram=4, percent=85)


def op4_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that an earlier document has."""
    return cover.digests(cover.dedup(table(spark, sf_dir, "documents")))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of all documents, stored once, and the current policy's verdicts."""
    path = scratch_dir(spark, "ledger")
    rules.ledger(table(spark, sf_dir, "documents")).write.parquet(path)
    return (spark.read.parquet(path)
            .withColumn("base_failed", ~rules.passes(rules.BASE_POLICY))
            .withColumn("kept", rules.passes(rules.BASE_POLICY) & rules.passes(rules.POLICY)))


def op6_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur twice."""
    return suffixes.digests(suffixes.dedup(table(spark, sf_dir, "documents")))


def op7_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_span_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the rules' spans, and the model's added."""
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.fit(docs)))


def op9_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents and their decoding, as digests."""
    return pieces.digests(pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op10_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; the ids of each piece as a checksum."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by the production rules."""
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, urlrules.RULES))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents."""
    return interactions.audit(interactions.combinations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_centroid_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return turntrie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_slot_sharding": op1_slot_sharding,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_partenum_join": op3_partenum_join,
    "op4_cover_dedup": op4_cover_dedup,
    "op5_rule_ledger": op5_rule_ledger,
    "op6_suffix_levels": op6_suffix_levels,
    "op7_block_neighbours": op7_block_neighbours,
    "op8_span_crf": op8_span_crf,
    "op9_chunk_pieces": op9_chunk_pieces,
    "op10_tier_packing": op10_tier_packing,
    "op11_url_rules": op11_url_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_trie": op13_centroid_trie,
}
