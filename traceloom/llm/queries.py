"""Registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_main, jaccard_join, kd_means, line_dedup, packing, quality_rules, rank_bpe, spelling, sstable, toxicity, url_tree, vector_graph, word_bpe
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"_q.{n}").alias(n) for n in names], "base_failed", "kept", F.col("fired").alias("rule"))


def op5_host_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages"))


#: The rules of the url query, fixed by its contract.
URL_RULES = [
    url_tree.UrlRule("block", "com", "/en/"),
    url_tree.UrlRule("allow", "example.com", "/en/7"),
    url_tree.UrlRule("allow", "net", "/de/"),
    url_tree.UrlRule("block", "example.net", "/de/8"),
    url_tree.UrlRule("block", "org", "/es/"),
]


def op6_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page carries the label of the document whose number ends its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("low"))
    number = F.expr("try_cast(regexp_extract(url, '([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) as bigint)")
    # Urls without a number get keys of their own, so that they do not meet in one task of the join.
    number = F.coalesce(number, -1 - F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 40)))
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id", "left")
    judged = url_tree.filter_urls(labelled, F.col("low"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


#: Pieces of text whose ids a worker remembers where tokenising is the only work.
REMEMBERED = 800_000


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, remembered=REMEMBERED)


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_kept")


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select(F.col("key").alias("doc_id"), "severity", "grade", "toxic", (~F.col("toxic")).alias("kept"))


def op8_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rank_bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sorted_table_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), remembered=REMEMBERED))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_kd_tree_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means.digest(kd_means.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3))


def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op13_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"), times=10, shortest=7, least=2, thinning=31)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_fuzzy_line_dedup": op3_fuzzy_line_dedup,
    "op4_rank_queue_bpe": op4_rank_queue_bpe,
    "op5_host_path_extraction": op5_host_path_extraction,
    "op6_url_template_tree": op6_url_template_tree,
    "op7_ordinal_toxicity": op7_ordinal_toxicity,
    "op8_robust_pruned_graph": op8_robust_pruned_graph,
    "op9_sorted_table_shards": op9_sorted_table_shards,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_kd_tree_means": op11_kd_tree_means,
    "op12_word_table_bpe": op12_word_table_bpe,
    "op13_spelling_halves": op13_spelling_halves,
}

#: The other operators are not expressible in SQL over whole tables; each is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op11_kd_tree_means": kd_means.oracle_sql()}
