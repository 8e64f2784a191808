"""The registered queries of the subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_session_key = secrets.token_hex(32)


def surrogate_key(spark: SparkSession) -> str:
    """The secret that the session names; without one, a random key that lives as long as this process."""
    return spark.conf.get("spark.polyview.surrogateKey", None) or _session_key


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.simple8b import read_token_ids, write_token_ids

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_ids(write_token_ids(docs, _tokenizer("byte_bpe_50k.json"))).drop("ids")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from polyview.llm.bpe_transducer import encode_decode

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest_only=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.near_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.substring_dedup import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.quality import score_quality

    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.line_dedup import remove_repeated_chunks

    out = remove_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.md5("text").alias("kept_md5"), "n_lines", "n_removed_lines")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.surrogates import replace_entities

    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), surrogate_key(spark))


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.inner_product import top_products

    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.page_text import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.fill_middle import fill_in_middle, restore

    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.chat_format import format_conversations, read_back

    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(own)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyview.llm.prefix_trie import number_turns, prefix_trie, rebuild

    return prefix_trie(*rebuild(number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {"op1_quality": op1_quality, "op2_line_dedup": op2_line_dedup, "op5_surrogates": op5_surrogates, "op8_top_products": op8_top_products, "op10_page_text": op10_page_text, "op4_substring_dedup": op4_substring_dedup, "op7_near_dedup": op7_near_dedup, "op3_token_ids": op3_token_ids, "op6_bpe": op6_bpe, "op9_packing": op9_packing, "op11_fill_middle": op11_fill_middle, "op12_chat_format": op12_chat_format, "op13_prefix_trie": op13_prefix_trie}


def _oracles() -> dict[str, str]:
    from polyview.llm import chat_format, fill_middle, inner_product, line_dedup, near_dedup, prefix_trie, substring_dedup

    return {"op4_substring_dedup": substring_dedup.ORACLE, "op7_near_dedup": near_dedup.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op12_chat_format": chat_format.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op8_top_products": inner_product.ORACLE}


ORACLES: dict[str, str] = _oracles()
