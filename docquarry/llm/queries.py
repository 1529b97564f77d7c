"""The registered queries of this subpackage (thin: digests of the operators' outputs) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import chat, decontam, gif, html_text, mixing, near_dup, pivot_index, prefix_trie, quality, secret_scan, sharding, token_counts, vector_codes
from docquarry.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the corpus: the ledger of the first, a part of the documents, is written; the second scans what that lacks."""
    docs = _table(spark, sf_dir, "documents")
    first = materialize(secret_scan.scan_incremental(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)), "secret-ledger")
    ledger = first.unionByName(secret_scan.scan_incremental(docs, first))
    found = F.coalesce(F.col("found"), F.array().cast(secret_scan.FOUND))
    joined = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.findings(docs, ledger).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, for each draw: the block it came in, the output shard that the tree dealt it to, its place there."""
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    each = [F.col(f"draws.{k}").alias(n) for k, n in (("block", "blocks"), ("shard", "shards"), ("position", "positions"))]
    return plan.select("doc_id", "size", "source_size", "target", "taken", *each)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(turns.unionByName(planted))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_covered")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = gif.media_columns(_table(spark, sf_dir, "documents"), media=False)
    hist = F.array_join(F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 8), lambda s, f: F.zip_with(s, f["hist_r"], lambda a, b: a + b)).cast("array<string>"), ",")
    time = F.aggregate("frames", F.lit(0), lambda s, f: s + f["delay_cs"])
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("cs="), time), F.concat(F.lit("hist="), hist))
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_sharding, op3_mixing, op6_chat_formatting, op7_html_extraction, op8_token_counts, op10_gif_media)
}
ORACLES: dict[str, str] = {}


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(_table(spark, sf_dir, "documents"), p=near_dup.NearParams(words=4))


QUERIES |= {f.__name__: f for f in (op4_decontamination, op9_near_dedup)}
ORACLES |= {"op1_secret_scan": secret_scan.oracle(), "op4_decontamination": decontam.oracle(), "op9_near_dedup": near_dup.oracle(near_dup.NearParams(words=4))}


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


QUERIES |= {op5_quality_classifier.__name__: op5_quality_classifier}


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES |= {op11_vector_codes.__name__: op11_vector_codes}
ORACLES |= {"op11_vector_codes": vector_codes.oracle()}


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), rebuilt=True)


QUERIES |= {f.__name__: f for f in (op12_near_vectors, op13_prefix_trie)}
ORACLES |= {"op12_near_vectors": pivot_index.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
