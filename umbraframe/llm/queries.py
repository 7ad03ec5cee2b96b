"""The queries of this folder and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from umbraframe.llm import bpe, chat, neardedup, planes, rlz, secrets, simhash, toxicity, wordpiece, wumanber
from umbraframe.llm.common import load, work_folder
from umbraframe.llm.oracles import ORACLES


def op1_secret_scan(spark, sf_dir):
    return secrets.secret_report(load(spark, sf_dir, "documents"))


def op2_simhash_golay(spark, sf_dir):
    return neardedup.near_duplicate_report(load(spark, sf_dir, "documents"))


def op3_chat_format(spark, sf_dir):
    return chat.chat_report(load(spark, sf_dir, "conversations"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.bpe_report(load(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir):
    return planes.token_file_report(load(spark, sf_dir, "documents"), work_folder(spark, "token-files"))


def op6_substring_dedup(spark, sf_dir):
    return rlz.repeats_report(load(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return wumanber.decontamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_token_counts(spark, sf_dir):
    return wordpiece.count_tokens(load(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash.fingerprints_in_order(load(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def simhash_search(spark, sf_dir):
    return simhash.search_classes(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_simhash_golay, op3_chat_format, op4_byte_bpe, op5_token_files, op6_substring_dedup, op7_decontamination, op8_token_counts, op9_simhash, op10_toxicity, simhash_search)
}

__all__ = ["ORACLES", "QUERIES"]
