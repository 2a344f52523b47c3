"""The queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from crawlsight.llm import chat, fingerprint, line_dedup, mixing, neighbours, packing, quality, simhash, token_counts, url_filter
from crawlsight.llm.common import shared_path, table, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as fetched over a year, under two lists with an entry dated by each page."""
    captures, entries = url_filter.pages_and_list(spark, sf_dir)
    return url_filter.filter_urls(captures, entries)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a plain transcript, its roles found again; the model is counted on labelled messages."""
    raw = chat.raw_transcripts(table(spark, sf_dir, "conversations"))
    return chat.format_chats(raw.drop("role"), chat.fit(raw))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents loaded; toxic ones deleted; German ones moved to a version with an end id; French ones counted anew."""
    counts = written(token_counts.counted(table(spark, sf_dir, "documents"), tokenizer_path()), "token-counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    live = counts.join(toxic, "doc_id", "left_anti")
    plain, ended = F.lit("byte_bpe_50k"), F.lit("byte_bpe_50k+end")

    def changes(rows: DataFrame, kind: str, version, tokens, old=None) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "source", "lang", version.alias("tokenizer_version"), tokens.alias("tokens"), (F.lit(0) if old is None else old).cast("long").alias("old_tokens"))

    tokens, german, french = F.col("tokens"), live.where("lang = 'de'"), live.where("lang = 'fr'")
    batches = {
        "load": changes(counts, "insert", plain, tokens),
        "toxic": changes(counts.join(toxic, "doc_id"), "delete", plain, tokens),
        "end-ids": changes(german, "delete", plain, tokens).unionByName(changes(german, "insert", ended, tokens + 1)),
        "trimmed": changes(french, "revise", plain, F.col("inner_tokens"), tokens),
    }
    rollup = token_counts.Rollup(spark, shared_path(spark, "token-rollup"))
    for name in ("load", "toxic", "end-ids", "toxic", "trimmed", "load"):  # two come again, and change nothing
        rollup.commit(name, batches[name])
    return rollup.totals()


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_chat_format": op2_chat_format,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_collision_counting": op7_collision_counting,
    "op8_token_rollup": op8_token_rollup,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
}

SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op5_source_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
