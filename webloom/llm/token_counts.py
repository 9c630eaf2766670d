"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content beside the SHA-256 of the tokenizer's file, so a count is
looked up, not computed, for any copy seen before, and a changed tokenizer never meets stale counts. Only distinct
misses are encoded; their counts are appended to the cache, a Parquet folder with one partition per tokenizer version.

Normalising may not change a count: runs of ASCII white space become one space and the ends are trimmed, which a
tokenizer that drops white space cannot see. Other tokenizers are refused by `word_vocabulary`; `normalise=False` keys
the cache by texts as they are.

Defined results. Null text: as an empty one, 0 tokens. Null ids, repeated rows and repeated ids: a row each. Empty
table: empty result, nothing is appended. Special strings inside texts count as the library's default has them. Other
columns are ignored. Two runs at once may append a digest twice; readers take one count per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.subword import slices, word_vocabulary

CACHE = "version STRING, digest BINARY, n_tokens BIGINT"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column, normalise: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    if normalise:
        text = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.unhex(F.sha2(text, 256))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) the cache has for a tokenizer version."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], CACHE).drop("version")
    found = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, key: str = "doc_id", text: str = "text", normalise: bool = True) -> DataFrame:
    """(key, n_bytes, n_tokens) for every row, encoding only what `cache` lacks.

    Texts move once, and only distinct misses do: map tasks keep one text per digest before the shuffle, so a text
    that fills a third of the rows arrives once per map task. The counts join on 32-byte digests.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    bare = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    keyed = bare.withColumn("digest", content_digest(F.col("text"), normalise))
    known = cached_counts(spark, cache, version)
    unknown = keyed.select("digest", "text")
    if _exists(spark, cache):
        unknown = unknown.join(known.select("digest"), "digest", "left_anti")
    misses = unknown.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = vocabulary.count(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, type=pa.int64())], names=["digest", "n_tokens"])

    found = misses.mapInArrow(encode, "digest BINARY, n_tokens BIGINT")
    found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.partitionBy("version").mode("append").parquet(cache)
    sized = keyed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "digest")
    return sized.join(cached_counts(spark, cache, version), "digest").select(F.col("doc_id").alias(key), "n_bytes", "n_tokens")
