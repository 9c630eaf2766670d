"""The inverted index as ordinary tables: docs, postings, terms, stats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions.text import kept_tokens, page_text, page_title
from webloom.functions.urls import host_port
from webloom.session import materialise

#: Weight of a word by field, kept words of a text, largest weight and length, sizes of segment classes.
TITLE_WEIGHT, DESCRIPTION_WEIGHT, TEXT_WEIGHT = 3, 2, 1
TEXT_WORDS, MOST = 40, 65535
LEVELS = (1_000, 8_000, 64_000, 512_000, 4_096_000)


@dataclass(frozen=True)
class Index:
    """docs(doc_id, url, host, title, dl), postings(term, doc_id, tf, dl), terms(term, df); a stored one also has its stats in one row.

    A posting has its document's length, so scores need no look at docs.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame | None = None

    def write(self, path: str) -> Index:
        """Lay the tables out for lookups: postings and terms sorted in ranges, so that row groups are skipped. A common term may fill many ranges."""
        return _lay_out(self.docs, self.postings.repartitionByRange("term", "doc_id"), path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "terms", "stats")))


def text_pages(docs: DataFrame) -> DataFrame:
    """The documents table as plain-text pages of synthetic sites."""
    host = F.concat("source", F.lit(".example.org"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", url.alias("url"), page_title(F.col("text")).alias("title"), F.lit("").alias("description"), page_text(F.col("text")).alias("text"))


def _kept(name: str):
    return kept_tokens(F.coalesce(name, F.lit("")))


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", host_port(F.col("url"))).where("coalesce(host, '') <> ''")


def tokenised(pages: DataFrame) -> DataFrame:
    """(doc_id, url, host, title, dl, words) from (doc_id, url, title, description, text): lengths and weighted words, counted in the row.
    Each field's words are found once for both."""
    kept = (_kept("title").alias("__title"), _kept("description").alias("__description"), F.slice(_kept("text"), 1, TEXT_WORDS).alias("__text"))
    fields = (("__title", TITLE_WEIGHT), ("__description", DESCRIPTION_WEIGHT), ("__text", TEXT_WEIGHT))
    length = sum((F.size(name) * weight for name, weight in fields), F.lit(0))
    words = F.concat(*(F.transform(name, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))) for name, weight in fields))
    rows = _with_host(pages).select("doc_id", "url", "host", "title", *kept)
    return rows.select("doc_id", "url", "host", "title", F.least(length, F.lit(MOST)).alias("dl"), words.alias("words"))


def _word_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "dl", F.explode("words").alias("word")).select("doc_id", "dl", "word.term", "word.w")


def _summed(each: DataFrame) -> DataFrame:
    return each.groupBy("term", "doc_id").agg(F.least(F.sum("w"), F.lit(MOST)).cast("int").alias("tf"), F.max("dl").alias("dl"))


def build_index(pages: DataFrame) -> Index:
    """From (doc_id, url, title, description, text). Pages without a host are left out; pages without words count as documents.

    Postings are one aggregation whose partial sums are taken where the pages are read.
    """
    return index_of(tokenised(pages))


def index_of(rows: DataFrame) -> Index:
    """build_index, from the rows that `tokenised` gives."""
    postings = _summed(_word_rows(rows))
    return Index(rows.drop("words"), postings, postings.groupBy("term").agg(F.count("*").alias("df")))


def store_index(pages: DataFrame, path: str) -> Index:
    """build_index, written for lookups. Texts are read once: their words are staged, then dealt out by range, and the same deal serves
    the sums and the order in the files."""
    spark = pages.sparkSession
    tokenised(pages).write.mode("overwrite").parquet(f"{path}/staged")
    rows = spark.read.parquet(f"{path}/staged")
    return _lay_out(rows.drop("words"), _summed(_word_rows(rows).repartitionByRange("term", "doc_id")), path)


def _lay_out(docs: DataFrame, postings: DataFrame, path: str) -> Index:
    """`postings` come dealt by range of (term, doc_id)."""
    spark = docs.sparkSession
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    postings.select("term", "doc_id", "tf", "dl").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    written = Index(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "terms")))
    corpus_stats(written).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return Index.read(spark, path)


def corpus_stats(index: Index) -> DataFrame:
    """n_docs, total_dl, avg_dl (1 at least), n_hosts, n_terms in one row."""
    if index.stats is not None:
        return index.stats
    docs = index.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_dl"), F.count_distinct("host").alias("n_hosts"))
    avg = F.greatest(F.lit(1.0), F.coalesce(F.try_divide("total_dl", "n_docs"), F.lit(0.0)))
    return docs.select("n_docs", "total_dl", avg.alias("avg_dl"), "n_hosts", index.terms.agg(F.count("*")).scalar().alias("n_terms"))


def segment_level(count) -> F.Column:
    """Size class of a segment of so many documents."""
    level = F.lit(len(LEVELS))
    for n, most in reversed(list(enumerate(LEVELS))):
        level = F.when(count < most, n).otherwise(level)
    return level


def packed_lists(index: Index) -> DataFrame:
    """(term, df, pairs): postings in list form, each list cut into stretches of document ids so that no row holds a common word whole."""
    stretch = F.floor(F.col("doc_id") / 65536)
    return index.postings.groupBy("term", stretch.alias("stretch")).agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("pairs"))


def dense_ids(pages: DataFrame, order: list[str], offset: int = 0) -> DataFrame:
    """doc_id = offset, offset + 1, ... in `order`: ranges of the order, counted, then numbered inside each.

    The dealt rows are written with the number of their range. Counting and numbering both read that: dealt twice, rows could
    come to lie in other ranges the second time.
    """
    dealt = materialise(pages.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__nth", inside).join(before, "__range").withColumn("doc_id", F.col("__before") + F.col("__nth") - 1 + offset).drop("__range", "__nth", "__before")
