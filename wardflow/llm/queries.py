"""The operators' queries over the supplied tables: opN_<name>(spark, sf_dir), and the SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import collocations, conversations, decontaminate, line_dedup, lm_scoring, mixing, packing, quality_rules, rule_ensemble, simhash, substring_dedup, surrogates, token_ids
from wardflow.llm._util import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.read_ids(token_ids.write_ids(_table(spark, sf_dir, "documents"), tokenizer_file(), Workspace(spark)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), Workspace(spark))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), Workspace(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Workspace(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def surrogate_key(spark: SparkSession) -> bytes:
    """The key that the session holds in spark.wardflow.surrogateKey; where it is unset, a new one that nobody keeps."""
    return spark.conf.get("spark.wardflow.surrogateKey", "").encode() or secrets.token_bytes(32)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents"), Workspace(spark), surrogate_key(spark))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Workspace(spark))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "pages"), Workspace(spark))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(_table(spark, sf_dir, "documents"), Workspace(spark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), Workspace(spark))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), Workspace(spark))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), Workspace(spark))


def queries() -> dict:
    own = [op1_token_ids, op2_lm_scoring, op3_simhash, op4_substring_dedup, op5_decontaminate, op6_quality_rules, op7_surrogates, op8_rule_ensemble, op9_line_dedup, op10_mixing, op11_collocations, op12_conversation_repair, op13_best_fit_packing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_conversation_repair": conversations.ORACLE}
