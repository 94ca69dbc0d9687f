"""The queries of this package over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import chat, collocations, conversation_repair, knn, language_id, mixing, ngram_join, oracles, packing, quality_rules, secrets, token_files, url_filter

URL_RULES = [
    url_filter.UrlRule("block", "com", "en/"),
    url_filter.UrlRule("allow", "example.com", "en/7"),
    url_filter.UrlRule("block", "net", "de/"),
    url_filter.UrlRule("allow", "example.net", "de/8"),
    url_filter.UrlRule("block", "org", "es/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, f'{{"prompt": "{said}", "response": "{said}"}}')], "conv_id long, record string")
    turns = chat.table_turns(_read(spark, sf_dir, "conversations")).union(chat.canonical_turns(extra))
    return chat.digest_segments(chat.format_turns(turns))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_sample(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.llm import token_counts

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_knn": op1_knn,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_chat": op7_chat,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_collocations": op11_collocations,
    "op12_secret_scan": op12_secret_scan,
    "op13_conversation_repair": op13_conversation_repair,
}
#: The others mix by pseudorandom draws, learn a model, or need a tokenizer: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_knn": oracles.OP1,
    "op3_quality_rules": oracles.OP3,
    "op4_url_filter": oracles.op4(URL_RULES),
    "op7_chat": oracles.OP7,
    "op10_ngram_join": oracles.OP10,
    "op11_collocations": oracles.op11(),
    "op12_secret_scan": oracles.op12(),
    "op13_conversation_repair": oracles.OP13,
}
