"""Approximate nearest neighbours by a permutation index.

Pivots are a fixed number of vectors of the corpus. A vector is represented by its PREFIX nearest pivots in order, and
posted, with each pivot's place in that order, in the inverted files of those pivots. A query reads the files of its own
nearest pivots; a row's footrule distance is the sum of the differences of places, a pivot missing from either order
counting as place PREFIX. The rows nearest by footrule are reranked by the exact measure, the inner product in double
precision.

The index is kept in segments of about SEGMENT rows and queries in blocks of about BLOCK, both dealt by hash. A segment
moves once, to the task that searches it; blocks of queries travel to the segments. Each (segment, block) is one unit of
work of bounded memory. In each segment SHARE of the rows, and as many as are asked for at least, are reranked for every
query, at every size, so the share examined does not depend on the size of the corpus. Rows of equal vectors are one
entry: an index entry stands for all of them, and the best k + 1 ids of each are enough for any query.

Pivots are fitted on PIVOTS distinct vectors, those with the smallest hash of their id. Every row is indexed.

Defined results. Vectors that are null, empty, all zero, of another length than most, or that hold null or non-finite
components take no part, as row or as query; nor do rows of null ids. A query's own row is never its answer, rows equal
to it are. Ties go to the smaller id. Rows with equal ids and vectors count once. Empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.session import materialise

PIVOTS, PREFIX = 256, 64
SEGMENT, BLOCK = 8192, 512
SHARE = 0.25


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's `prefix` nearest pivots, nearest first; ties go to the smaller pivot number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Segment:
    """Some rows' vectors and the pivots' inverted files over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, pivots: int):
        self.ids, self.vectors, self.prefix = ids, vectors, orders.shape[1]
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.places = (by_pivot // self.prefix).astype(np.int32), (by_pivot % self.prefix).astype(np.int32)
        self.begins = np.searchsorted(orders.ravel()[by_pivot], np.arange(pivots + 1))

    def search(self, vector: np.ndarray, order: np.ndarray, keep: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best `keep` of the rows nearest by footrule distance."""
        many = max(keep, int(np.ceil(share * len(self.ids))))
        rows = np.arange(len(self.ids))
        if many < len(rows):
            # Footrule distance less what it is for an order that shares no pivot.
            footrule = np.zeros(len(rows), dtype=np.int32)
            for place, pivot in enumerate(order):
                files = slice(self.begins[pivot], self.begins[pivot + 1])
                there = self.places[files]
                footrule[self.rows[files]] += np.abs(there - place) - (self.prefix - there) - (self.prefix - place)
            rows = np.argpartition(footrule, many - 1)[:many]
        scores = np.einsum("ij,j->i", self.vectors[rows], vector)
        best = np.lexsort((self.ids[rows], -scores))[:keep] if len(rows) <= 4 * keep else self._best(rows, scores, keep)
        return self.ids[rows[best]], scores[best]

    def _best(self, rows: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
        cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((self.ids[rows[some]], -scores[some]))[:keep]]


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def search_nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for each row for which `queries` (a condition on column vec_id) holds,
    with `share` of each segment reranked."""
    members = k + 1  # one may be the query itself
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE"
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == width["n"]).withColumn("class", F.xxhash64("v")).distinct()
    spark = vectors.sparkSession

    # Equal vectors: one class, named by its smallest id (the hash is only a shorter grouping key beside the vector).
    best = W.partitionBy("class", "v").orderBy("vec_id")
    ranked = rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= members)
    classes = materialise(ranked.groupBy("class", "v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = materialise(rows.where(queries).join(classes.select("class", "v", "id"), ["class", "v"]).select(F.col("vec_id").alias("query_id"), "id"), "asked")
    asking = classes.join(asked.select("id").distinct(), "id", "left_semi")

    pivot_rows = classes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in pivot_rows]))  # PIVOTS vectors
    segments, blocks = max(1, -(-classes.count() // SEGMENT)), max(1, -(-asking.count() // BLOCK))

    def gather(table: pa.Table) -> pa.Table:
        ids, matrix = table.column("id").to_numpy(), _matrix(table.column("v"))
        orders = nearest_pivots(matrix, pivots.value, PREFIX)
        return pa.table({"part": table.column("part")[:1], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "matrix": pa.array([matrix.astype("<f8").tobytes()], pa.binary()), "orders": pa.array([orders.astype("<i4").tobytes()], pa.binary())})

    def parts(df: DataFrame, many: int) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("part"), "id", "v")
        return dealt.groupBy("part").applyInArrow(gather, "part INT, ids BINARY, matrix BINARY, orders BINARY")

    index = parts(classes, segments).select(F.col("part").alias("segment"), F.struct("ids", "matrix", "orders").alias("rows"))
    batch = parts(asking, blocks).select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.struct("ids", "matrix", "orders").alias("queries"))

    def arrays(cell: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(cell["ids"], "<i8")
        return ids, np.frombuffer(cell["matrix"], "<f8").reshape(len(ids), -1), np.frombuffer(cell["orders"], "<i4").reshape(len(ids), -1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for i in range(table.num_rows):
                segment = Segment(*arrays(table.column("rows")[i].as_py()), len(pivots.value))
                found = [(q, *segment.search(v, o, members, share)) for q, v, o in zip(*arrays(table.column("queries")[i].as_py()))]
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], sizes), pa.int64()), pa.array(np.concatenate([ids for _, ids, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, _, s in found]), pa.float64())], names=["asking", "id", "score"])

    hits = index.join(batch, "segment").select("rows", "queries").mapInArrow(find, "asking BIGINT, id BIGINT, score DOUBLE")
    nearest = W.partitionBy("asking").orderBy(F.desc("score"), "id")
    top = hits.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= members)
    # The best ids of each class asked for, then each query's own share of them.
    spread = top.join(classes.select("id", "ids"), "id").select("asking", "score", F.explode("ids").alias("vec_id"))
    each = W.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    lists = spread.withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= members)
    lists = lists.groupBy("asking").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    own = asked.join(lists, asked["id"] == lists["asking"]).select("query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    out = own.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
