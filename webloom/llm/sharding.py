"""Sharding by jump consistent hashing, in DataFrame expressions only.

Law `key`: the stable key and the number of shards alone decide the shard. A key's walk visits growing
bucket numbers drawn from a 64-bit linear congruential generator that the key seeds; its shard among n is
the last bucket below n. So appending a shard moves about 1/(n+1) of the keys, all of them into the new
shard, and no ring table exists that would have to be built, shipped or kept in step.

Slots number a shard's rows from 0 without gaps, in order of (key, size, checksum). No task sees a whole
shard: rows are dealt by ranges of the key with a salt for repeated rows, each (shard, range) is ranked on
its own, and the ranges' counts are summed up in front of it.

Defined results. Null key: as key 0, returned as null. Null or empty text: no bytes, checksum 0. Repeated
rows share a shard and get neighbouring slots. An empty table gives an empty result. Columns other than
the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.session import materialise

#: Fixed values of the published algorithm: multiplier of its generator, and bytes counted for a row beside its text.
MULTIPLIER = 2862933555777941757
ROW_BYTES = 8


def _next_state(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2**64 from 16- and 32-bit limbs, since ANSI multiplication must not wrap."""
    high, low = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    u = F.shiftrightunsigned
    k0, k1 = k.bitwiseAND(0xFFFF), u(k, 16).bitwiseAND(0xFFFF)
    k2, k3 = u(k, 32).bitwiseAND(0xFFFF), u(k, 48)

    def carried(a: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(0xFFFF), 16)

    low_sum = k0 * F.lit(low) + carried(k1 * F.lit(low)) + F.lit(1)
    high_sum = u(low_sum, 32) + u(k1 * F.lit(low), 16) + k2 * F.lit(low) + carried(k3 * F.lit(low)) + k0 * F.lit(high) + carried(k1 * F.lit(high))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    return F.shiftleft(high_sum.bitwiseAND(mask), 32).bitwiseOR(low_sum.bitwiseAND(mask))


def jump_shards(key: Column, *counts: int) -> Column:
    """Struct of one int per shard count: the key's shard among that many. Each step grows the bucket by one at least, so max(counts) steps end every walk."""
    most = max(counts)
    names = [f"of_{n}" for n in counts]
    start = F.struct(key.cast("bigint").alias("state"), F.lit(0).cast("bigint").alias("next"), *[F.lit(0).cast("bigint").alias(n) for n in names])

    def step(walk: Column, _: Column) -> Column:
        state = _next_state(walk["state"])
        draw = F.shiftrightunsigned(state, 33) + F.lit(1)
        jump = F.floor((walk["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("bigint")
        going = walk["next"] < F.lit(most)
        return F.struct(
            F.when(going, state).otherwise(walk["state"]).alias("state"),
            F.when(going, jump).otherwise(walk["next"]).alias("next"),
            *[F.when(walk["next"] < F.lit(n), walk["next"]).otherwise(walk[name]).alias(name) for n, name in zip(counts, names)],
        )

    def finish(walk: Column) -> Column:
        return F.struct(*[walk[name].cast("int").alias(name) for name in names])

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, finish)


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    Only (key, size, checksum) travel: the text is reduced to them in the scan. Two shuffles of those
    small rows: by key range, then by (shard, range) for the ranks, whose counts join on the same keys.
    """
    bare = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"),
    )
    dealt = bare.repartitionByRange("doc_id", "size", "text_crc32", "salt").select(
        "doc_id",
        "size",
        "text_crc32",
        jump_shards(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), shards, shards + 1).alias("at"),
        F.spark_partition_id().alias("range"),
    )
    rows = materialise(dealt.select("doc_id", "size", "text_crc32", "range", F.col(f"at.of_{shards}").alias("shard"), F.col(f"at.of_{shards + 1}").alias("grown_shard")), "shards")
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    return ranked.join(counts, ["shard", "range"]).select(
        F.col("doc_id").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )
