"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from veilspark.llm import collocations
from veilspark.llm import decontaminate as decon
from veilspark.llm import hard_negatives, line_dedup, lm_hmm, minhash, packing, pieces, quality_rules, site_quality, suffix_dedup
from veilspark.llm import toxicity, warc
from veilspark.llm.common import held_out, table

TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "toxic")
    learn = docs.join(labels, F.col("doc_id") == F.col("label_id")).filter(~held_out(F.col("doc_id"), 3))
    scored, name = toxicity.score(docs, toxicity.train(learn))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), F.col(name).alias("score"),
                         (F.col(name) >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_site_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return site_quality.score(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op3_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("lines_removed")
    return line_dedup.deduplicate(docs, drop_emptied=False, report=True).select(
        "doc_id", r["n_lines"].alias("n_lines"), r["n_removed"].alias("n_removed"), r["n_runs"].alias("n_runs"),
        F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[F.col(f"{r}_fence") for r in quality_rules.RULES])


def op6_minhash(spark, sf_dir):
    return minhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decon.scan(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    r = F.col(name)
    return found.select(
        "doc_id", r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"),
        F.size(r["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", r["item_ids"]), 256).alias("items_sha256"),
        (r["n_hit"] > 0).alias("contaminated"))


def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.derive(warc.responses(pages)).drop("warc_headers").withColumnRenamed("key", "page_id")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lm_hmm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.col("doc_id")
    model = lm_hmm.train(docs.filter(~held_out(out, 5)), key="doc_id")
    return lm_hmm.score(docs, model).select(
        "doc_id", held_out(out, 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.mine(rows, relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(docs, public_tokenizers.path(PIECE_MODEL))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_site_quality": op2_site_quality,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_lm_hmm": op10_lm_hmm,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLES = {"op7_decontamination": decon.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL,
           "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL}
