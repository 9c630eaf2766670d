"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within r bits share a point within r/2 bits of both. So every distinct fingerprint emits all its
variants within half the radius, the variants are the shuffle key, and fingerprints that meet there are the candidate
pairs; each is verified by its true distance. A variant's bucket can hold at most as many distinct fingerprints as it
has neighbours itself, so no bucket grows with the corpus, whatever group of copies it serves; copies have met before,
as one fingerprint. Within a bucket each fingerprint is linked to the smallest only, which joins the same components.

Components come from alternating large-star and small-star passes over the links between fingerprints, each pass written
to the shared folder; no link, fingerprint or component is collected.

Defined results. Null text: as an empty one. A text without words has fingerprint zero, linked as any other. Fewer words
than a shingle: all of them are one shingle. Null ids: kept, and never a component's name unless it has no other. Rows
with equal ids: a row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.subword import release_memory, slices
from webloom.session import materialise

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words of the text with A-Z lower-cased, repeats included."""
    found = (text or "").encode().lower().split()  # on bytes both look at ASCII only
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(b" ".join(found), SEED)], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    begins = np.append(0, ends[:-1])[: len(found) - words + 1].tolist()
    view = memoryview(joined)
    return np.array([hashed(view[a:b], SEED) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
            release_memory()

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, "doc_id BIGINT, fp BIGINT")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """All numbers of `bits` bits with at most `radius` of them set, as signed 64-bit numbers."""
    found = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


#: Variants that one task of the explosion makes.
VARIANTS_A_TASK = 1 << 20


def ball_links(prints: DataFrame, radius: int, bits: int = BITS) -> DataFrame:
    """(a, b, distance), a < b: links between distinct fingerprints (column fp of a written table) within `radius` bits.

    Every two fingerprints within the radius are in one component of these links. Fingerprints that share a variant differ
    in twice the ball's bits at most. For even radii that is the radius, so each is linked to its bucket's smallest only;
    for odd ones a bucket's fingerprints, as many as there are masks at most, are compared with each other.
    """
    ball = masks((radius + 1) // 2, bits)
    near = F.array(*[F.lit(m).cast("bigint") for m in ball])
    distinct = prints.select("fp").distinct()
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * len(ball) // VARIANTS_A_TASK))
    # By a hash of fp: a repartition by fp itself is taken to be the one of `distinct`, which is coalesced to a few tasks.
    spread = distinct.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.transform(near, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    # The fingerprints of a bucket lie within the ball around its variant: as many as there are masks at most.
    met = spread.groupBy("variant").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    if radius % 2:
        met = met.select(F.posexplode("fps").alias("at", "a"), "fps").select("a", F.slice("fps", F.col("at") + 2, F.lit(len(ball))).alias("others"))
    else:
        met = met.select(F.get("fps", F.lit(0)).alias("a"), F.slice("fps", 2, len(ball)).alias("others"))
    pairs = met.select("a", F.explode("others").alias("b")).distinct()
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).where(F.col("distance") <= radius)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Large-star links a node's larger neighbours to its smallest one, small-star its smaller ones; both keep the
    components and end in stars. The smallest neighbour is a partial aggregate, so a hub with many links costs one row
    for each map task; the join on it is one that AQE can split.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        pulled = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = materialise(pulled.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "small")
        found = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = found


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest doc_id its links reach."""
    prints = materialise(fingerprints(docs, words, key, text), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(ball_links(prints, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Shingles found in COMMON_LEAST texts of a sample of 1 / COMMON_SAMPLE, and in 1 / COMMON_SHARE of it, count as common.
COMMON_SAMPLE, COMMON_LEAST, COMMON_SHARE = 16, 3, 5000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))


def prefix_tokens(shingles: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in one order for all texts, so many that two sets of that Jaccard similarity share one of them.

    Such sets share at least similarity * n of either's n shingles, so one is among the first n - ceil(similarity * n) + 1
    of both, whatever the order. Common shingles (ascending, with their counts) come last, so few texts meet by them.
    A text without words has the token 0.
    """
    if not len(shingles):
        return np.zeros(1, dtype=np.uint64)
    count = np.zeros(len(shingles), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[at] == shingles, counts[at], 0)
    first = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return shingles[np.lexsort((shingles, count))[:first]]


def text_digest(text):
    """16 bytes of SHA-256, as a text's name."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def jaccard(a: str | None, b: str | None, words: int) -> float:
    """Of the sets of word shingles; 1 for two texts without words."""
    one, two = shingle_set(a, words), shingle_set(b, words)
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared / (len(one) + len(two) - shared) if len(one) or len(two) else 1.0


#: Least number of cells in which a text's shingles are counted, shingles a cell beyond that, and the count from which a cell only says "many".
CELLS, LOAD, MANY = 256, 8, 255


def cell_counts(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each cell. The number of cells is a power of two that grows with the text, so long texts stay apart."""
    cells = CELLS << max(0, (len(shingles) // (CELLS * LOAD)).bit_length())
    return np.minimum(np.bincount((shingles % np.uint64(cells)).astype(np.int64), minlength=cells), MANY).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int, similarity: float) -> bool:
    """Whether sets of these cell counts and sizes can have that Jaccard similarity: they share no more than the cells allow."""
    one, two = (np.frombuffer(x, dtype=np.uint8) for x in (a, b))
    if (one == MANY).any() or (two == MANY).any():
        return True
    cells = min(len(one), len(two))
    # A number's cell among fewer is its cell modulo their number, as both are powers of two.
    one, two = (x.reshape(-1, cells).sum(axis=0, dtype=np.int64) for x in (one, two))
    return bool((1 + similarity) * np.minimum(one, two).sum() >= similarity * (n_a + n_b) - 1e-6)


def common_shingles(bare: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of `bare` (digest, text), ascending, and their counts in the sample. Only the order of tokens, and so the work, depends on them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *found]).view(np.int64))], names=["token"])

    sample = bare.where(F.pmod(F.xxhash64("digest"), F.lit(COMMON_SAMPLE)) == 0)
    least = max(COMMON_LEAST, -(-sample.count() // COMMON_SHARE))
    # COMMON_SHARE times a text's shingles at most.
    found = sample.select("text").mapInArrow(make, "token BIGINT").groupBy("token").count().where(F.col("count") >= least).toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


#: Digests of texts to be verified that are broadcast at most, 16 MB of them; for more, all texts are shuffled to them once.
ASKED_ROWS = 1 << 20
#: Texts by this fingerprint distance or less are the first candidates.
NEAR_BITS = 2


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(a, b, similarity) between digests of different texts whose `words`-word shingle sets have that Jaccard similarity or more.

    Every two such texts are in one component of these links. Candidates come in three steps, each sifted by cell counts and
    verified on whole texts. (1) SimHash fingerprints within NEAR_BITS meet in their balls. Texts of that similarity can be
    ten bits apart, further than balls reach, so the rest meet by a token of their prefixes, which loses none: (2) each
    token's texts are compared with that one of them that meets most others, as the source of many copies does; (3) all
    that meet and are not in one component yet are compared with each other, but for those that meet too late in their
    prefixes to share enough of what follows. A text takes part at a token only if one of the next size there, smaller or
    larger, can be that similar by size and place; similar texts are never further apart than those.
    """
    bare = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(text_digest("text").alias("digest"), "text")
    common = bare.sparkSession.sparkContext.broadcast(common_shingles(bare, words))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.sort(np.unique(np.array(batch.column("digest").to_pylist(), dtype=object), return_index=True)[1])  # a batch's copies once
            for part in slices(batch.take(pa.array(first)), "text", most=2 << 20):
                hashes = [shingle_hashes(t.as_py(), words) for t in part.column("text")]
                prints = np.array([fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashes]
                tokens = [prefix_tokens(s, similarity, *common.value).view(np.int64) for s in sets]
                cells = [part.column("digest"), pa.array(map(len, sets), pa.int32()), pa.array(prints), pa.array(tokens, pa.list_(pa.int64())), pa.array(map(cell_counts, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["digest", "n", "fp", "tokens", "cells"])
            release_memory()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cells_a", "cells_b", "n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array((may_be_similar(*pair, similarity) for pair in zip(*columns)), pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [jaccard(x.as_py(), y.as_py(), words) for x, y in zip(batch.column("text_a"), batch.column("text_b"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
            release_memory()

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that are similar. b is the one with many partners: its text joins last and is not sent once a pair."""
        one, two = (printed.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}")) for x in "ab")
        pairs = materialise(pairs.join(one, "a").join(two, "b").mapInArrow(sift, "a BINARY, b BINARY"), "sifted")
        asked = materialise(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), "asked")
        asked = F.broadcast(asked) if asked.count() <= ASKED_ROWS else asked
        texts = materialise(bare.join(asked, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")), "texts")
        left = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a BINARY, b BINARY, similarity DOUBLE").where(F.col("similarity") >= similarity)

    def candidates(met: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) from columns x, y (structs n, rest, digest) that can have the similarity; b is a pair's y.

        `rest` counts a text's shingles from the one they meet by onwards. At a pair's first common shingle all they share
        lies in both rests, so a similar pair passes there if nowhere else. Where rest is n, only the sizes are looked at.
        """
        fit = (1 + similarity) * F.least("x.rest", "y.rest") >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-6
        pairs = met.where(fit).groupBy(F.least("x.digest", "y.digest").alias("low"), F.greatest("x.digest", "y.digest").alias("high")).agg(F.max("y.digest").alias("b"))
        return pairs.select(F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("a"), "b")

    def without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        both = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(both, ["a", "b"], "left_anti")

    printed = materialise(bare.mapInArrow(make, "digest BINARY, n INT, fp BIGINT, tokens ARRAY<BIGINT>, cells BINARY").dropDuplicates(["digest"]), "prefixes")

    # Of equal fingerprints each text is compared with the smallest, as is the smallest of a linked fingerprint.
    text_of = F.struct("n", F.col("n").alias("rest"), "digest")
    firsts = materialise(printed.groupBy("fp").agg(F.min(text_of).alias("y")), "firsts")
    same = printed.join(firsts, "fp").where("digest <> y.digest").select(text_of.alias("x"), "y")
    balls = ball_links(printed, NEAR_BITS).join(firsts.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), "y"), "b")
    near = materialise(candidates(same.unionByName(balls.select("x", "y"))), "near")

    spread = printed.select("digest", "n", F.posexplode("tokens").alias("at", "token")).withColumn("rest", F.col("n") - F.col("at")).drop("at")
    by_size = W.partitionBy("token").orderBy("n")
    smaller, larger = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = (smaller >= similarity * F.col("n") - 1e-6) | (larger <= (1 + similarity) / similarity * F.col("rest") - F.col("n") + 1e-6)
    counted = spread.select("*", F.count("*").over(by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("texts"), fits.alias("fits"))
    met = materialise(counted.where("fits").drop("fits"), "met")
    weighed = met.join(met.groupBy("digest").agg(F.sum("texts").alias("weight")), "digest")
    hubs = weighed.groupBy("token").agg(F.max(F.struct("weight", "n", "digest")).alias("y"))
    stars = met.join(hubs, "token").where("digest <> y.digest").select(text_of.alias("x"), F.struct("y.n", F.col("y.n").alias("rest"), "y.digest").alias("y"))
    tried = materialise(near.unionByName(without(candidates(stars), near)), "stars")
    links = materialise(verified(tried), "star_links")

    roots = components(links)
    placed = met.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").select("token", "n", "rest", "digest", F.coalesce("root", "digest").alias("root"))
    placed = materialise(placed, "placed")
    # Of two components, one is not the token's largest.
    largest = placed.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    within = placed.join(largest, "token").select("token", "root", "largest", F.struct("n", "rest", "digest").alias("text"))
    other = within.where("root <> largest.root").select("token", F.col("root").alias("root_x"), F.col("text").alias("x"))
    across = other.join(within.select("token", F.col("root").alias("root_y"), F.col("text").alias("y")), "token").where("root_x <> root_y")
    left = materialise(without(candidates(across), tried), "across")
    return links.unionByName(verified(left))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group of linked texts the row with the smallest key stays (nulls last).

    Groups decide on digests and keys; partial minima leave a row for a text and a map task, whatever its copies. Whole rows
    move once, by text and key together, so no group meets in one task. Of rows equal in both, one stays. Null texts are
    empty ones; texts without words are copies of each other; all columns return as they are, whatever their names.
    """
    roots = components(similar_links(docs, words, similarity, text))
    rows = docs.select(F.struct("*").alias("row"), text_digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.struct(F.col(key).isNull(), F.col(key)).alias("place"))
    least = rows.groupBy("digest").agg(F.min("place").alias("place"))
    rooted = least.join(roots, least["digest"] == roots["node"], "left").select("digest", "place", F.coalesce("root", "digest").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("place", "digest")).alias("kept")).select("kept.place", "kept.digest")

    def name(df: DataFrame) -> DataFrame:
        return df.withColumn("name", F.concat_ws(":", F.hex("digest"), F.col("place")[key].cast("string"), F.col("place.col1").cast("string")))

    named = name(rows).select("row", "name").join(name(kept).select("name"), "name", "left_semi")
    return named.withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy("name"))).where("nth = 1").select("row.*")
