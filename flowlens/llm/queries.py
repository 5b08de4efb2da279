"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import chat, decontaminate, fingerprints, langid, lm, ngram_join, oracle, packing, quality_gam, rules, token_counts, urls, variants, whitening
from flowlens.llm.common import bucket_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from ids whose crc32 is not divisible by 5; predicts every text."""
    docs = _table(spark, sf_dir, "documents")
    held = bucket_of_id(F.col("doc_id"), 5) == 0
    net = langid.fit(docs.select("doc_id", "text", "lang").where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


#: Fixed rows: a conversation that holds the control strings of common templates.
TRICKY = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply chain, formatted, and read back from its formatted string."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = chat.conversations(chat.linear_tree(turns.union(extra)))
    back = out.select("tree", F.col("formatted").alias("f"), chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("m").cast("long").alias("loss_chars"),
        F.sha2(F.col("m").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("f").cast("long").alias("formatted_chars"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of ids whose crc32 modulo 4 is not 2; scores every text."""
    docs = _table(spark, sf_dir, "documents")
    held = bucket_of_id(F.col("doc_id"), 4) == 2
    model = quality_gam.fit(docs.select("doc_id", "text").where(~held), _table(spark, sf_dir, "labels").where(~held))
    return quality_gam.score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mines the urls of documents labelled as poor; judges every page by the fixed rules, then by the mined ones."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").where("quality is not null").groupBy(F.col("doc_id").alias("__doc")).agg((F.avg("quality") < 0.5).alias("bad"))
    labelled = pages.select("url", urls.label_key(F.col("url")).alias("__doc")).where("__doc is not null").join(labels, "__doc")
    return urls.judge(pages, urls.mine(labelled)).select("page_id", "host", "path", "rule", "verdict")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from ids whose crc32 modulo 7 is not 2; scores every text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of_id(F.col("doc_id"), 7) == 2)
    return lm.score(docs, "not held_out", extra=("held_out",))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, counted between end ids of flat token files."""
    return token_counts.counted_documents(_table(spark, sf_dir, "documents"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the leading components of the covariance of all of them, scaled to variance one."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all texts, each with its near words and the form that it may be a spelling of."""
    return variants.forms(variants.word_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likenesses."""
    return fingerprints.edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_format": op4_chat_format,
    "op5_decontamination": op5_decontamination,
    "op6_quality_gam": op6_quality_gam,
    "op7_url_rules": op7_url_rules,
    "op8_lm_score": op8_lm_score,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_feast_whitening": op11_feast_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash_fingerprints": op13_minhash_fingerprints,
}
ORACLE: dict[str, str] = oracle.ORACLE
