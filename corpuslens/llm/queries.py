"""The registered queries: each operator over its whole table, with production parameters, and its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import alignment, decontaminate, langid, packing, quality, records, repeats, secrets, sharding, simhash, trie, urls, warc
from corpuslens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards_of(table(spark, sf_dir, "documents"), shards=16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, F.col("shard").cast("int").alias("shard"), "slot", grown)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), [F.col("doc_id")], n=10)
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removals(table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer(), capacity=1024, end_id=0)


@query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    base = tuple(rule.kind for rule in secrets.BASE_RULES)
    return found.select(
        "doc_id", *[secrets.count("spans", rules, kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.listed("spans", rules, base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed("spans", rules).alias("spans"),
    )


@query
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judged(pages, urls.rule_table(spark), default="allow")
    return found.select(F.col("c0").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), revisit_from=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt_paths(table(spark, sf_dir, "conversations"), block=100, heads=6))


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id")
    profiles = langid.learn(docs.where(~held_out))
    found = langid.predicted(docs.select("doc_id", "text", held_out.alias("held_out")), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


ORACLES |= {
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op9_url_filters": urls.ORACLE,
    "op10_warc_archives": warc.ORACLE,
    "op11_conversation_trie": trie.ORACLE,
}
