"""Best-fit packing of token sequences by linear grouping.

How good a packing is depends on lengths alone, and a piece has at most `capacity` of them. So the corpus is reduced to
a histogram of lengths, one plan is made for it on the driver - its size depends on the capacity, not on the corpus -
and documents then take the plan's places by their rank among pieces of equal length:

1. Pieces longer than capacity / SMALL are sorted by length and cut into groups of equal cardinality; each length is
   rounded up to its group's largest. Steps 1 to 4 run for several numbers of groups; the fewest sequences win.
2. Configurations (how many of each size share a sequence) are optimised for the rounded sizes: the fractional
   cutting-stock problem by column generation, each column priced by a knapsack; whole parts of it are opened.
3. The actual lengths are put back in their groups' places, which sets free what rounding had added.
4. The pieces that are left - those of fractional parts, then all small ones - are placed longest first, each into the
   sequence with the least room that still suffices; new sequences open only if none does.

Equal lengths and equal rooms are handled together as intervals, so step 4 takes as many moves as there are different
lengths and intervals, not documents.

Defined results. Null text: empty; an empty text is one piece holding the end id. Null, repeated and clashing ids: each
row is packed by itself. Empty table: no sequences. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.id_files import with_end
from webloom.llm.subword import slices, word_vocabulary
from webloom.session import materialise

GROUPS = (12, 24, 48, 96)
SMALL = 8
PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, task INT, nth BIGINT"


@dataclass
class Plan:
    """Places: ranks [rank, rank + count) of a length go to sequences bin, bin + 1, ..."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    bin: np.ndarray
    bins: int

    def assign(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        keys = (self.length.astype(np.int64) << 48) + self.rank
        at = np.searchsorted(keys, (lengths.astype(np.int64) << 48) + ranks, side="right") - 1
        inside = ranks - self.rank[at]
        if len(at) and ((at < 0) | (self.length[at] != lengths) | (inside >= self.count[at])).any():
            raise ValueError("a piece has no place: the plan was made for other lengths")
        return self.bin[at] + inside


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable way to fill a sequence: unbounded knapsack, one copy of a size at a time."""
    value, taken = np.zeros(capacity + 1), []
    for size, w in zip(sizes, worth):
        for _ in range(capacity // size if w > 1e-12 else 0):
            offered = np.full(capacity + 1, -1.0)
            offered[size:] = value[:-size] + w
            won = offered > value + 1e-12
            taken.append(won)
            value = np.where(won, offered, value)
    column, room, step = np.zeros(len(sizes), dtype=np.int64), capacity, len(taken)
    for k in reversed(range(len(sizes))):
        for _ in range(capacity // sizes[k] if worth[k] > 1e-12 else 0):
            step -= 1
            if taken[step][room]:
                column[k] += 1
                room -= sizes[k]
    return column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how often) with whole multiplicities that never exceed the demand."""
    basis = np.diag(capacity // sizes).astype(float)
    use = demand / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_column(sizes, worth, capacity)
        if worth @ column <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        use = np.maximum(use - step * change, 0)
        basis[:, leaves], use[leaves] = column, step
    return [(basis[:, j].astype(np.int64), int(use[j] + 1e-9)) for j in range(len(sizes)) if use[j] >= 1 - 1e-9]


def make_plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS) -> Plan:
    """The plan with the fewest sequences among those for the given numbers of groups; the first that reaches the volume bound ends the search."""
    bound, best = -(-sum(length * n for length, n in histogram.items()) // capacity), None
    for many in groups:
        plan = plan_with_groups(histogram, capacity, many)
        if best is None or plan.bins < best.bins:
            best = plan
        if best.bins <= bound:
            break
    return best


def plan_with_groups(histogram: dict[int, int], capacity: int, groups: int) -> Plan:
    """A packing of `histogram[length]` pieces of each length into sequences of `capacity`."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    places: list[tuple[int, int, int, int]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, dtype=bool)
    used, bins = np.zeros(capacity + 1, dtype=np.int64), 0

    def place(length: int, first: int, n: int) -> None:
        places.append((length, int(used[length]), n, first))
        used[length] += n

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            there[room] = True

    large = [l for l in range(capacity, capacity // SMALL, -1) if counts[l]]
    if counts[capacity]:
        place(capacity, 0, int(counts[capacity]))
        bins, large = int(counts[capacity]), large[1:]
    left = counts - used
    if large:
        # Linear grouping: boundaries by cardinality, equal lengths stay together.
        order = np.array(large)
        ahead = np.cumsum(left[order]) - left[order]
        group = np.minimum(ahead * groups // max(1, int(left[order].sum())), groups - 1)
        names = np.unique(group)
        members = [order[group == g] for g in names]
        sizes, demand = np.array([m[0] for m in members]), np.array([int(left[m].sum()) for m in members])
        cursor = [[(int(l), int(left[l])) for l in m] for m in members]
        for column, times in configurations(sizes, demand.astype(float), capacity):
            # Never more than a group still has.
            for k in np.flatnonzero(column):
                times = min(times, sum(n for _, n in cursor[k]) // int(column[k]))
            slots = [k for k in np.flatnonzero(column) for _ in range(column[k])]
            while times:
                # The longest stretch of sequences in which every place has one length. Places of one group take its lengths in turn.
                heads, stretch = [], times
                for k in dict.fromkeys(slots):
                    stretch = min(stretch, max(1, cursor[k][0][1] // int(column[k])))
                room = capacity
                for k in slots:
                    length, n = cursor[k][0]
                    if n < stretch:
                        raise AssertionError("a stretch is longer than its length's pieces")
                    heads.append(length)
                    cursor[k][0] = (length, n - stretch)
                    if n == stretch:
                        cursor[k].pop(0)
                    place(length, bins, stretch)
                    room -= length
                leave(room, bins, stretch)
                bins += stretch
                times -= stretch
    left = counts - used
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fits = np.flatnonzero(there[length:])
            if not len(fits):
                each = min(capacity // length, n)
                full = n // each
                for _ in range(each):
                    place(length, bins, full)
                leave(capacity - each * length, bins, full)
                bins, n = bins + full, n - each * full
                continue
            room = length + int(fits[0])
            first, free = rooms[room].pop()
            there[room] = bool(rooms[room])
            # Best fit puts more pieces of this length into the same sequence while they fit it.
            each = min(room // length, n)
            some = min(free, n // each)
            for _ in range(each):
                place(length, first, some)
            leave(room - each * length, first, some)
            leave(room, first + some, free - some)
            n -= each * some
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], bins)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) with the task that made it and its rank among that task's pieces of its length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, task, seen = word_vocabulary(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = with_end(*vocabulary.encode(part.column("text")), end_id)
                per = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                fresh = np.append(True, ordered[1:] != ordered[:-1])
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))
                nth = np.empty(len(length), dtype=np.int64)
                nth[order] = np.arange(len(ordered)) - first + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text.

    Texts are encoded where they are read. Afterwards only rows of fixed size move: to their (task, length) counts, and
    to their sequence, which holds `capacity` pieces at most.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer, end_id, capacity, key, text), "pieces")
    counts = pieces.groupBy("task", "length").count()
    ahead = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity))  # bounded by the lengths, not by the corpus

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            bins = plan.value.assign(batch.column("length").to_numpy(), ranks)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"])

    placed = pieces.join(bases, ["task", "length"]).mapInArrow(assign, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, sequence_id BIGINT")
    within = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).withColumnRenamed("doc_id", key)
