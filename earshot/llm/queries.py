"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import answers, bpe, chat, conversation_repair, decontamination, hard_negatives, licenses, near_dedup, packing, pii, quality_rules, secrets, sharding, simhash
from earshot.llm.scratch import Scratch
from earshot.session import configure

#: The installed tokenizer file that the encoding query and the pipeline use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers  # only installed where the tokenizer files are

    return str(public_tokenizers.path(TOKENIZER))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.Rule(shingle=3, percent=85))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def encoding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


#: One conversation whose texts look like markup.
MARKUP = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(MARKUP, "conv_id bigint, turn bigint, role string, text string"))
    return chat.read_back(Scratch(spark).stage(chat.format_windows(turns), "chat_windows"))


def _path() -> Column:
    """Documents lie in a folder for each source and, below, language."""
    return F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), _path())


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), _path())


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put into turns by the checksum of their place; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(n == 1, "").when(n == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(n == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.where(n != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.audit(damaged(conversations), conversations)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), simhash.Rule(shingle=3, distance=2))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is wrong on purpose."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination_query,
    "op2_secret_scan": secrets_query,
    "op3_chat_formatting": chat_query,
    "op4_license_scan": licenses_query,
    "op5_bpe_encoding": encoding_query,
    "op6_pii": pii_query,
    "op7_packing": packing_query,
    "op8_quality_rules": quality_query,
    "op9_sharding": sharding_query,
    "op10_near_dedup": near_dedup_query,
    "op11_conversation_repair": repair_query,
    "op12_simhash_dedup": simhash_query,
    "op13_hard_negatives": negatives_query,
}
SQL: dict[str, str] = answers.TEXTS
