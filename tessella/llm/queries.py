"""The operators as named queries over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, collocations, extraction, oracles, resampling
from tessella.llm.fingerprints import next_and_edited
from tessella.llm.jaccard import near_duplicates
from tessella.llm.mixing import mix
from tessella.llm.packing import pack
from tessella.llm.scoring import score
from tessella.llm.secrets import digest, learn, scan
from tessella.llm.session import fresh_path
from tessella.llm.token_files import read_token_files, write_token_files
from tessella.llm.topk import top_k
from tessella.llm.toxicity import scored, train

VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_and_edited(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.preferences(chat.last_turn_pairs(table(spark, sf_dir, "conversations"))))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), remainder(10) != 0, tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), uri, tokenizer_path(), end_id=1)
    return read_token_files(spark, uri, with_ids=False)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), learn()))


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    found = scored(docs.select("doc_id", "text"), model).withColumn("held_out", remainder(5) == 0)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"), extraction.default_model())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_top_k": op2_top_k,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op5_preferences": op5_preferences,
    "op6_lm_scores": op6_lm_scores,
    "op7_token_files": op7_token_files,
    "op11_main_text": op11_main_text,
    "op12_collocations": op12_collocations,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op2_top_k": oracles.TOP_K,
    "op5_preferences": oracles.PREFERENCES,
    "op10_mixing": oracles.MIXING,
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_resampling": oracles.RESAMPLING,
}
