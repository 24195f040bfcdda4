"""The op queries: each applies one operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brieflake.llm import clustering, licenses, quality
from brieflake.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.tokens import token_table

    return token_table(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.html import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.pii import digest, find

    return digest(find(read_table(spark, sf_dir, "documents")))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.chat import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.language import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.decontamination import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))[0]


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.clustering import cluster

    return cluster(read_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brieflake.llm.quality import rate

    return rate(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_licenses": op5_licenses,
    "op6_ann": op6_ann,
    "op7_chat": op7_chat,
    "op8_language": op8_language,
    "op9_tokens": op9_tokens,
    "op10_decontaminate": op10_decontaminate,
    "op11_whiten": op11_whiten,
    "op12_cluster": op12_cluster,
    "op13_quality": op13_quality,
}

#: The other queries hold fitted models, seeded choices, hashes or decoded files; tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_licenses": licenses.oracle_sql(), "op12_cluster": clustering.oracle_sql(), "op13_quality": quality.oracle_sql()}
