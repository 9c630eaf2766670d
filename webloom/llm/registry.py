"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from webloom.llm.byte_bpe import encode_texts
from webloom.llm.id_files import read_ids, write_ids
from webloom.llm import secrets
from webloom.llm.media import image_features, text_images
from webloom.llm.neighbours import search_nearest
from webloom.llm.packing import pack_documents
from webloom.llm.quality import fit_quality, in_learning_part, score_quality
from webloom.llm.sharding import shard_rows
from webloom.llm.simhash import near_duplicates
from webloom.llm.token_counts import count_tokens
from webloom.session import materialise, scratch_path, table

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
#: Session setting that names the folder of stored token counts; without it a run has a cache of its own.
TOKEN_CACHE = "spark.webloom.tokenCache"


def op1_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = in_learning_part(F.col("doc_id"))
    scored = score_quality(docs, fit_quality(docs, labels, learn=learn))
    return scored.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path(BYTE_BPE)
    decoded = encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1, capacity=4096)


def op4_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"), 24)


def op5_media_columns(spark, sf_dir):
    stored = materialise(text_images(table(spark, sf_dir, "documents")), "images")
    return image_features(stored).drop("error")


def op6_permutation_index(spark, sf_dir):
    return search_nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op8_token_counts(spark, sf_dir):
    cache = spark.conf.get(TOKEN_CACHE, None) or scratch_path(spark, "token_counts")
    counts = count_tokens(table(spark, sf_dir, "documents"), cache, public_tokenizers.path(WORD_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_id_files(spark, sf_dir):
    path = scratch_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=1)
    return read_ids(spark, path)


def op10_secret_scans(spark, sf_dir):
    weights = secrets.train(secrets.default_samples(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), weights)
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql():
    return {}
