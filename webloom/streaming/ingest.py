"""Incremental ingest: pages arrive as files, each micro-batch becomes a segment that searches can read."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from webloom.functions.codec import fnv1a
from webloom.operators.index import LEVELS, Index, dense_ids, index_of, tokenised
from webloom.sources.lists import WEEK
from webloom.sources.responses import stored_pages

#: Seconds between micro-batches; pages, bytes and seconds after which a sender's batch is due, and bytes that a
#: page takes beside its fields; segments that are merged at a time.
BATCH_SECONDS = 1
SEND_PAGES, SEND_BYTES, SEND_SECONDS, PAGE_BYTES = 100, 2 << 20, 3, 100
MERGED_AT_ONCE = 4


def page_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 16, dictionary: bytes = b"") -> DataFrame:
    """Pages from files of stored-page lines as they arrive."""
    return stored_pages(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), dictionary=dictionary)


def commit_batch(pages: DataFrame, batch_id: int, path: str, order: list[str], replace: bool = False) -> None:
    """One segment from one micro-batch, with ids that follow the earlier batches'. Pages seen before are left out or, with
    `replace`, are new versions: the page's older one is not read any more. Every page with a host counts, also one without words;
    `line_stream` leaves out blank lines where it reads them.

    Texts are read once, for their words, which are staged for docs and postings. Everything lands in folders of the batch; a replayed batch
    looks only at the batches before it and overwrites its own folders, so it gives the same ids and no page twice. The manifest entry, written last, makes it visible.
    """
    spark = pages.sparkSession
    named = pages.withColumn("hash", fnv1a(F.col("url"))).dropDuplicates(["hash"])
    offset = again = 0
    if _exists(spark, f"{path}/manifest"):
        earlier = spark.read.parquet(f"{path}/manifest").where(F.col("batch") < batch_id)
        offset = earlier.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
        if offset:
            seen = spark.read.parquet(f"{path}/seen").where(F.col("batch") < batch_id).select("hash")
            if replace:
                again = named.select("hash").join(seen, "hash", "left_semi").count()
            else:
                named = named.join(seen, "hash", "left_anti")
    staged = f"{path}/pages/batch={batch_id}"
    dense_ids(named, order, offset).write.mode("overwrite").parquet(staged)
    kept = spark.read.parquet(staged)
    tokenised(kept).write.mode("overwrite").parquet(f"{path}/words/batch={batch_id}")
    index = index_of(spark.read.parquet(f"{path}/words/batch={batch_id}"))
    index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch_id}")
    index.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
    counted = spark.read.parquet(f"{path}/postings/batch={batch_id}").groupBy("term").agg(F.count("*").alias("df"))
    counted.write.mode("overwrite").parquet(f"{path}/terms/batch={batch_id}")
    kept.select("hash", "doc_id").write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
    kept.agg(F.count("*").alias("n_docs"), F.lit(again).cast("bigint").alias("n_again")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


def start_ingest(stream: DataFrame, path: str, checkpoint: str, order: list[str], once: bool = False, replace: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda df, n: commit_batch(df, n, path, order, replace)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{BATCH_SECONDS} second")
    return writer.start()


@dataclass(frozen=True)
class Segment:
    """Batches `first` to `last`, `n_docs` pages in all; `merged` if they have been written as one."""

    first: int
    last: int
    n_docs: int
    merged: bool

    def folder(self, path: str, table: str) -> str:
        return f"{path}/merged/{self.first}-{self.last}/{table}" if self.merged else f"{path}/{table}/batch={self.first}"


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """What a reader sees, in order of batches: the widest merges, and batches that are in none. One row a batch or merge comes to the driver."""
    whole = [Segment(r["batch"], r["batch"], r["n_docs"], False) for r in spark.read.parquet(f"{path}/manifest").select("batch", "n_docs").collect()]
    if _exists(spark, f"{path}/merges"):
        whole += [Segment(r["first"], r["last"], r["n_docs"], True) for r in spark.read.parquet(f"{path}/merges").collect()]
    out: list[Segment] = []
    for s in sorted(whole, key=lambda s: (s.first, -s.last, not s.merged)):
        if not out or s.first > out[-1].last:
            out.append(s)
    return out


def _read(spark: SparkSession, path: str, table: str, chosen: list[Segment]) -> DataFrame:
    return spark.read.parquet(*(s.folder(path, table) for s in chosen))


def read_index(spark: SparkSession, path: str) -> Index:
    """The index of all batches that the manifest lists, without versions that later batches replace. Term counts are sums of the
    segments' own, unless versions were replaced."""
    chosen = segments(spark, path)
    docs, postings, terms = (_read(spark, path, table, chosen) for table in ("docs", "postings", "terms"))
    manifest = spark.read.parquet(f"{path}/manifest")
    if not manifest.agg(F.sum("n_again")).first()[0]:
        return Index(docs, postings, terms.groupBy("term").agg(F.sum("df").alias("df")))
    seen = spark.read.parquet(f"{path}/seen").join(F.broadcast(manifest.select("batch")), "batch", "left_semi")  # one row for each batch
    old = seen.join(seen.groupBy("hash").agg(F.max("doc_id").alias("newest")), "hash").where("doc_id < newest").select("doc_id")
    docs, postings = (rows.join(old, "doc_id", "left_anti").select(*rows.columns) for rows in (docs, postings))
    return Index(docs, postings, postings.groupBy("term").agg(F.count("*").alias("df")))


def merge_once(spark: SparkSession, path: str) -> bool:
    """Write the first MERGED_AT_ONCE neighbouring segments of one size class as one; False if there are none.

    Batches stay as they are; the entry in `merges`, written last, makes readers use the merged segment.
    """
    live = segments(spark, path)
    levels = [bisect_right(LEVELS, s.n_docs) for s in live]
    for at in range(len(live) - MERGED_AT_ONCE + 1):
        run = live[at : at + MERGED_AT_ONCE]
        if len(set(levels[at : at + MERGED_AT_ONCE])) == 1:
            one = Segment(run[0].first, run[-1].last, sum(s.n_docs for s in run), True)
            _read(spark, path, "docs", run).write.mode("overwrite").parquet(one.folder(path, "docs"))
            sorted_postings = _read(spark, path, "postings", run).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            sorted_postings.write.mode("overwrite").parquet(one.folder(path, "postings"))
            _read(spark, path, "terms", run).groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(one.folder(path, "terms"))
            entry = spark.createDataFrame([(one.first, one.last, one.n_docs)], "first int, last int, n_docs bigint")
            entry.coalesce(1).write.mode("append").parquet(f"{path}/merges")
            return True
    return False


def compact(spark: SparkSession, path: str, target: str) -> Index:
    """Join all segments into one, sorted by term."""
    return read_index(spark, path).write(target)


def send_batches(pages: DataFrame, sender: str, order: str, at: str) -> DataFrame:
    """`pages` with batch_no: the number, from 0, of the sender's batch that takes each page, in `order`.

    A batch is sent when it has SEND_PAGES pages or SEND_BYTES bytes, and when a clock that ticks every SEND_SECONDS from the
    sender's first page has ticked between two pages (column `at`, in seconds). State is one row a sender; senders are streamed
    through their task in order, so no group is held.
    """
    names = [sender, order, at, "url", "title", "description", "text"]
    size = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in names[3:]), F.lit(PAGE_BYTES))
    rows = pages.select(F.struct("*").alias("page"), F.col(sender).cast("string").alias("sender"), F.col(order).alias("at_order"), F.col(at).cast("double").alias("seconds"), size.alias("bytes"))
    dealt = rows.repartition("sender").sortWithinPartitions("sender", "at_order")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, began, tick, n, held, batch_no = object(), 0.0, 0, 0, 0, 0
        for batch in batches:
            out = []
            for who, seconds, size in zip(*(batch.column(c).to_pylist() for c in ("sender", "seconds", "bytes"))):
                if who != current:
                    current, began, tick, n, held, batch_no = who, seconds or 0.0, 0, 0, 0, 0
                now = tick if seconds is None else max(tick, int((seconds - began) // SEND_SECONDS))
                if now > tick and n:
                    n, held, batch_no = 0, 0, batch_no + 1
                tick = now
                out.append(batch_no)
                n, held = n + 1, held + size
                if n >= SEND_PAGES or held >= SEND_BYTES:
                    n, held, batch_no = 0, 0, batch_no + 1
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.int32())], names=["page", "batch_no"])

    schema = f"page {rows.schema['page'].dataType.simpleString()}, batch_no INT"
    return dealt.mapInArrow(number, schema).select("page.*", "batch_no")


def recrawl_due(stream_or_table: DataFrame, key: str, ts: str, now, seconds: int = WEEK) -> DataFrame:
    """(key, last): keys whose last visit is more than `seconds` before `now`."""
    last = stream_or_table.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.unix_timestamp(now) - F.unix_timestamp("last") > seconds)


def host_counts(pages: DataFrame, host: str = "host") -> DataFrame:
    """Running page counts; on a stream, state holds one row a host."""
    return pages.groupBy(host).agg(F.count("*").alias("pages"))
