"""The operators of this subpackage as queries over whole tables, with SQL where DuckDB can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesight.llm import (chat, chunk_dedup, decontaminate, host_rules, license_scan, oracles, packing,
                           prefix_trie, sharding, simhash, suffix_dedup, toxicity, url_filter, zone_clusters)
from citesight.llm.common import table, with_rid
from citesight.plans.registry import register


@register("op1_decontaminate", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_url_filter", oracles.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_host_rules", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents"))


@register("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@register("op9_chunk_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.deduplicate(docs, added=("n_bytes", "n_removed", "n_spans"))


#: The conversation that the contract adds, as (role, text) by turn; fixed values.
PLANTED = (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"))


@register("op10_chat", oracles.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def nth(k):
        return F.get(F.array(*[F.lit(p[k]) for p in PLANTED]), F.col("id").cast("int"))
    planted = spark.range(len(PLANTED)).select(
        *[c.cast(f.dataType).alias(f.name) for c, f in zip((F.lit(-1), F.col("id"), nth(0), nth(1)), rows.schema.fields)],
        F.col("id").alias("rid"))
    events = with_rid(rows).unionByName(planted).select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("rid").alias("message"),
        "role", "text")
    back = chat.read_back(chat.chat(events))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@register("op11_prefix_trie", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@register("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


@register("op13_centroid_clusters", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.cluster(table(spark, sf_dir, "embeddings"))
