"""The operators applied to their whole tables, and the same in SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharedrift.llm import bpe, chat, html, licenses, lm, mixing, pieces, quality, simhash, spelling, topk, trie, urls
from sharedrift.llm.common import table

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_RULES, ALLOW_RULES = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")
# First labels of domains the url filter blocks, with their subdomains, wherever they occur in the corpus.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
VECTOR_SCALE, TOP_K, QUERY_EVERY = 1024, 10, 100


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    lengths = [len(rule) - rule.index("/") for rule in BLOCK_RULES + ALLOW_RULES]
    domain = F.explode(urls.domains(urls.host_of(F.col("url")))).alias("key")
    listed = pages.select(domain).filter(F.substring_index("key", ".", 1).isin(*LISTED_LABELS)).distinct()

    def rules(keys: tuple[str, ...]) -> DataFrame:
        return spark.createDataFrame([(key,) for key in keys], "key string")

    return urls.judge(pages, rules(BLOCK_RULES).union(listed), rules(ALLOW_RULES), lengths).select(
        "page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    formatted = chat.format_conversations(turns.union(extra))
    read = formatted.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("_turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.integer_vector(F.col("embedding"), VECTOR_SCALE).alias("vector"))
    return topk.top_k(rows, rows.filter(F.pmod("id", F.lit(QUERY_EVERY)) == 0), TOP_K).withColumnRenamed("id", "vec_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, pieces.read_model(PIECE_MODEL), decoded="decoded").drop("text")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(pieces.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_byte_bpe, op3_url_filter, op4_license_scan, op5_simhash, op6_chat_format, op7_exact_top_k,
        op8_quality_rules, op9_lm_score, op10_html_text, op11_sentencepiece, op12_prefix_trie, op13_spelling_variants)
}
