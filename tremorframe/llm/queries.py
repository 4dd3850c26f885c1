"""The contract queries: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, divergence, htmltext, licenses, lm, media, mixing, neardup, packing, quality, spelling, substring, toxicity
from .oracles import ORACLES
from .shared import remainder, table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    weights = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_media_columns(spark, sf_dir):
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.read_media(stored, keep=("doc_id", "n_bytes"))


def op3_quality_rules(spark, sf_dir):
    rows = quality.quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    training = F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(True))
    rows = lm.score(docs, training)
    return rows.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.replicate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "mix_rate", "mix_copies", "mix_copy")


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark, sf_dir):
    """All conversations, and one of its own whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(table(spark, sf_dir, "conversations"))
    return chat.read_back(chats.union(chat.format_chats(own)))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), damage=31))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_media_columns, op3_quality_rules, op4_license_scan, op5_minhash_near_dedup, op6_html_extraction, op7_language_model, op8_substring_dedup, op9_mixing, op10_packing, op11_source_divergence, op12_chat_formatting, op13_spelling_variants)}

__all__ = ["ORACLES", "QUERIES"]
