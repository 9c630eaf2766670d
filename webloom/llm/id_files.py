"""Token-id files of patched frame-of-reference blocks.

A file part holds whole documents. Their ids, one after the other, are cut into blocks of 128; a block stores its
minimum, then each id's difference from it in w bits. w comes from the block's own percentiles: of the widths that hold
80, 90, 95, 98, 99 and 100 per cent of the differences, the one that makes the block smallest. Differences beyond w
bits are patched: their low bits stay in place, and an exception list gives position and high bits. An index of block
starts lets a reader decode any span of ids alone.

Layout of a part, little-endian: magic "PFR1"; u32 block size, u64 number of documents, of ids, of blocks; per document
its id as i64, a null flag u8 and its number of ids as u64; per block its start as u64 (from the first block); the
blocks: u32 minimum, u8 width, u8 number of exceptions, packed differences, exceptions' positions u8, high bits u32.

Parts are written as binary cells of a Parquet folder (shard, part, documents, ids, content): Spark's commit protocol
then makes a rewritten or speculative task harmless, on any store. Shards ascend by document id.

Defined results. Null text: empty, so its end id alone. Null ids come first. Rows with equal ids: each its own entry,
ordered by a hash of the text. An empty table: no parts. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.subword import slices, word_vocabulary

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILES = (80, 90, 95, 98, 99, 100)
HEADER = struct.Struct("<4sIQQQ")
PART_IDS = 1 << 20
PART_SCHEMA = "shard INT, part INT, n_docs BIGINT, n_ids BIGINT, content BINARY"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value of each row, as rows of bytes."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype(">u4")).view(np.uint8).reshape(*values.shape, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(len(values), -1), axis=1)


def _unpack(rows: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1)[:, : count * width].reshape(len(rows), count, width)
    full = np.zeros((len(rows), count, 32), dtype=np.uint8)
    full[:, :, 32 - width :] = bits
    return np.packbits(full.reshape(len(rows), -1), axis=1).view(">u4").astype(np.uint32)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the blocks, their starts). The last block is filled up with its own minimum; the part's length tells."""
    if not len(ids):
        return b"", np.empty(0, dtype=np.uint64)
    tail = -len(ids) % BLOCK
    full = np.concatenate([ids.astype(np.uint32), np.full(tail, ids[len(ids) - len(ids) % BLOCK :].min() if tail else 0, dtype=np.uint32)]).reshape(-1, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    need = _bits(np.sort(rest, axis=1))
    best, width = np.full(len(full), np.inf), np.zeros(len(full), dtype=np.int64)
    for p in PERCENTILES:
        w = need[:, -(-BLOCK * p // 100) - 1]
        cost = w * BLOCK / 8 + 5 * (need > w[:, None]).sum(axis=1)
        better = cost < best
        best[better], width[better] = cost[better], w[better]
    beyond = _bits(rest) > width[:, None]
    exceptions = beyond.sum(axis=1)
    sizes = 6 + width * BLOCK // 8 + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    head = np.empty((len(full), 6), dtype=np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, exceptions
    out[starts[:, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]):
        these = np.flatnonzero(width == w)
        out[(starts[these] + 6)[:, None] + np.arange(w * BLOCK // 8)] = _pack(rest[these], int(w))
    row, place = np.nonzero(beyond)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        at = starts[row] + 6 + width[row] * BLOCK // 8
        out[at + nth] = place
        high = (rest[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = high
    return out.tobytes(), starts.astype(np.uint64)


def unpack_blocks(blocks: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The first n_ids ids of the blocks at `starts`; any run of blocks can be given."""
    starts = starts.astype(np.int64)
    least = blocks[starts[:, None] + np.arange(4)].view("<u4").ravel() if len(starts) else np.empty(0, dtype=np.uint32)
    width, exceptions = blocks[starts + 4].astype(np.int64), blocks[starts + 5].astype(np.int64)
    rest = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        these = np.flatnonzero(width == w)
        rest[these] = _unpack(blocks[(starts[these] + 6)[:, None] + np.arange(w * BLOCK // 8)], int(w), BLOCK)
    row = np.repeat(np.arange(len(starts)), exceptions)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        at = starts[row] + 6 + width[row] * BLOCK // 8
        high = blocks[(at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
        rest[row, blocks[at + nth]] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (rest + least[:, None]).ravel()[:n_ids]


def write_part(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = pack_blocks(ids)
    names = np.array([k or 0 for k in keys], dtype="<i8").tobytes()
    nulls = np.array([k is None for k in keys], dtype=np.uint8).tobytes()
    return b"".join([HEADER.pack(MAGIC, BLOCK, len(keys), len(ids), len(starts)), names, nulls, counts.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), blocks])


def read_part(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids)."""
    magic, block, n_docs, n_ids, n_blocks = HEADER.unpack_from(content)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a part of this format")
    at = HEADER.size
    names = np.frombuffer(content, "<i8", n_docs, at)
    nulls = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
    counts = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", n_blocks, at + 17 * n_docs)
    blocks = np.frombuffer(content, np.uint8, offset=at + 17 * n_docs + 8 * n_blocks)
    return [None if z else int(k) for k, z in zip(names, nulls)], counts, unpack_blocks(blocks, starts, n_ids)


def read_span(content: bytes, first: int, count: int) -> np.ndarray:
    """ids [first, first + count) of a part, decoding only the blocks that hold them."""
    _, _, n_docs, n_ids, n_blocks = HEADER.unpack_from(content)
    at = HEADER.size + 17 * n_docs
    low, high = first // BLOCK, -(-(first + count) // BLOCK)
    starts = np.frombuffer(content, "<u8", high - low, at + 8 * low)
    blocks = np.frombuffer(content, np.uint8, offset=at + 8 * n_blocks)
    return unpack_blocks(blocks, starts, (high - low) * BLOCK)[first - low * BLOCK :][:count]


def with_end(ids: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with end_id after each row, each row's number of ids with it)."""
    return np.insert(ids, begins[1:], np.uint32(end_id)), np.diff(begins) + 1


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append `end_id`, and write the parts in ascending order of `key`.

    Texts are dealt by ranges of the key (with the text's hash, so that one key's rows can be split), encoded and written
    by the task that sorts them; ids never move.
    """
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    bare = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), tie.alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"))
    dealt = bare.repartitionByRange("doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard, part = word_vocabulary(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", most=PART_IDS * 3):
                ids, counts = with_end(*vocabulary.encode(some.column("text")), end_id)
                content = write_part(some.column("doc_id").to_pylist(), counts, ids)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "content": pa.array([content], pa.binary())})
                part += 1

    dealt.mapInArrow(write, PART_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files under `path`.

    Starts come from the parts' own counts: summed within shards, then over shards, whose number is that of the
    writing tasks.
    """
    parts = spark.read.schema(PART_SCHEMA).parquet(path)
    sums = parts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = sums.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("shard", "part", inside.alias("inside")).join(shards, "shard").select("shard", "part", (F.col("before") + F.col("inside")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "content"))):
                keys, counts, flat = read_part(content)
                ends = np.cumsum(counts)
                raw, begins = flat.astype("<u4").tobytes(), ends - counts
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends)]
                n = len(keys)
                columns = {"shard": pa.array([shard] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "doc_id": pa.array(keys, pa.int64()), "inner": pa.array(begins, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "shard INT, part INT, doc_id BIGINT, inner BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + (", ids ARRAY<INT>" if ids else "")
    rows = parts.select("shard", "part", "content").mapInArrow(read, schema)
    return rows.join(bases, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
