"""Byte-level BPE by a global distinct-word shuffle.

Encoding has four steps. (1) Tasks split their texts into pre-tokens ("words") and write a block table: each block's
texts as positions of words in the block's own word list, and the list itself, dealt into buckets by a hash of the word.
(2) Word lists are shuffled by bucket, so all blocks' copies of a word meet in one task, which encodes each distinct word
once. A word comes once from a block, however often it is used: the most frequent word costs a row for each block, not
one for each use. (3) Ids go back to the words' blocks; the block table is bucketed by groups of blocks, so the join moves ids only,
not the texts' words. (4) Each block is reassembled by position. Decoding joins each id
with its bytes in the table of tokens by array index.

Words travel sorted and packed, many in a row. A block holds BLOCK bytes of text (one text at least); GROUP blocks share a
group number, by which the block table is bucketed, so a task writes a file for a group and not for a block. There are as
many buckets of words as a quarter of a shuffle's partitions, and a task remembers KNOWN words at most before it starts anew, so no
task's memory follows the input.

Ids are in BINARY cells as little-endian unsigned 32-bit numbers.

Defined results. Null text: as an empty one, no ids. Null and repeated ids of documents: a row each. Special strings are
ordinary text. Empty table: no rows. Other columns are ignored. Decoding null ids gives null; ids without a token raise.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.subword import Ragged, cut, release_memory, slices
from webloom.session import materialise_buckets

BLOCK, GROUP = 12 << 20, 8
KNOWN = 200_000
#: White space as the pattern's own library understands it (Unicode's White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = "array<struct<bucket:int,words:binary,lengths:binary,codes:binary>>"


def word_pattern(pattern: str) -> regex.Pattern:
    """The pre-token pattern with white space spelled out, inside classes and outside."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return regex.compile("".join(out))


class ByteVocabulary:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode_word = tiktoken.Encoding("ranks", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        by_id = [b""] * (max(ranks.values()) + 1)
        self.there = np.zeros(len(by_id), dtype=bool)
        for token, rank in ranks.items():
            by_id[rank] = token
            self.there[rank] = True
        sizes = np.array([len(t) for t in by_id], dtype=np.int64)
        self.bytes = Ragged(np.frombuffer(b"".join(by_id), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.max() >= len(self.there) or not self.there[ids].all()):
            raise ValueError("an id has no token")
        return self.bytes.gather(ids)[0].tobytes()


@functools.lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed with equal bytes of neighbours side by side."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def split_words(texts: pa.Array, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words of all texts as numbers into the list, where each text begins and the end, the distinct words: most used first)."""
    codes, segments, first = cut(texts)
    lists, sizes = [], []
    for at in range(0, len(segments), 1 << 16):  # few Python strings at a time
        found = [pattern.findall(s) for s in segments.slice(at, 1 << 16).cast(pa.large_string()).to_pylist()]
        sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        lists.append(pa.array([w for ws in found for w in ws], pa.large_string()))
    words = pa.chunked_array(lists, pa.large_string()).combine_chunks().dictionary_encode()
    length = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
    rows = Ragged(words.indices.to_numpy(), np.cumsum(length) - length, length)
    counts = np.zeros(len(words.dictionary), dtype=np.int64)
    ends = np.append(0, np.cumsum(length[codes]))
    stream = np.empty(int(ends[-1]), dtype=np.uint32)
    for at in range(0, len(codes), 1 << 19):
        part = rows.gather(codes[at : at + (1 << 19)])[0]
        stream[ends[at] : ends[at] + len(part)] = part
        counts += np.bincount(part, minlength=len(counts))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order))
    for at in range(0, len(stream), 1 << 20):
        stream[at : at + (1 << 20)] = place[stream[at : at + (1 << 20)]]
    return stream, ends[first], words.dictionary.cast(pa.large_binary()).take(pa.array(order)).to_pylist()


def _bucketed(words: list[bytes], buckets: int) -> list[dict]:
    """The words by bucket, each bucket's sorted and packed with their numbers."""
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
    order = sorted(range(len(words)), key=words.__getitem__)
    order = np.array(order, dtype=np.int64)[np.argsort(hashes[order], kind="stable")] if words else np.empty(0, dtype=np.int64)
    edges = np.searchsorted(hashes[order], np.arange(buckets + 1))
    out = []
    for bucket in range(buckets):
        these = order[edges[bucket] : edges[bucket + 1]]
        if len(these):
            chosen = [words[i] for i in these]
            out.append({"bucket": bucket, "words": zlib.compress(b"".join(chosen), 1), "lengths": _planes(np.array([len(w) for w in chosen])), "codes": _planes(these)})
    return out


def encode_texts(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) for every row; with `decoded` also the bytes that the ids decode to, by decode_ids in the same Python worker."""
    bare = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, block = word_pattern(pattern), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", most=BLOCK):
                stream, begins, words = split_words(part.column("text"), compiled)
                names = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
                pieces = pa.array([_bucketed(words, buckets)], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())])))
                cells = [pa.array([block // GROUP], pa.int64()), pa.array([block], pa.int64()), names, pa.array([_planes(np.diff(begins))], pa.binary()), pa.array([_planes(stream)], pa.binary()), pa.array([len(words)], pa.int64()), pieces]
                del stream, begins, words
                yield pa.RecordBatch.from_arrays(cells, names=["grp", "block", "doc_ids", "sizes", "stream", "n_words", "pieces"])
                del names, pieces, cells
                release_memory()
                block += 1

    made = bare.mapInArrow(split, f"grp BIGINT, block BIGINT, doc_ids ARRAY<BIGINT>, sizes BINARY, stream BINARY, n_words BIGINT, pieces {PIECES}")
    blocks = materialise_buckets(made, "blocks", "grp")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word, known, current = byte_vocabulary(ranks).encode_word, {}, None
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                if row["bucket"] != current or len(known) > KNOWN:
                    current, known = row["bucket"], {}
                raw, ends = zlib.decompress(row["words"]), np.cumsum(_numbers(row["lengths"]).astype(np.int64)).tolist()
                ids, at = [], 0
                for end in ends:
                    word, at = raw[at:end], end
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode_word(word)
                    ids.append(found)
                made = {"grp": [row["grp"]], "block": [row["block"]], "codes": [row["codes"]], "sizes": [_planes(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))], "ids": [_planes(np.array([i for x in ids for i in x], dtype=np.int64))]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for k, v in made.items()})
        known.clear()
        release_memory()

    lists = blocks.select("grp", "block", F.explode("pieces").alias("piece")).select("grp", "block", "piece.*")
    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
    encoded = dealt.mapInArrow(encode, "grp BIGINT, block BIGINT, codes BINARY, sizes BINARY, ids BINARY")
    # At most `buckets` cells of one block and GROUP blocks, together the distinct words of each.
    back = encoded.groupBy("grp").agg(F.collect_list(F.struct("block", "codes", "sizes", "ids")).alias("found"))

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                start, length = np.zeros(row["n_words"], dtype=np.int64), np.zeros(row["n_words"], dtype=np.int64)
                pools, base = [np.empty(0, dtype=np.uint32)], 0
                for cell in row["lists"] or []:
                    codes, sizes, pool = _numbers(cell["codes"]), _numbers(cell["sizes"]).astype(np.int64), _numbers(cell["ids"])
                    start[codes], length[codes] = base + np.cumsum(sizes) - sizes, sizes
                    pools.append(pool)
                    base += len(pool)
                known, stream = Ragged(np.concatenate(pools), start, length), _numbers(row["stream"])
                edges = np.append(0, np.cumsum(_numbers(row["sizes"]).astype(np.int64)))
                for at in range(0, len(row["doc_ids"]), 256):
                    own = edges[at : at + 257]
                    ids, begins = known.gather(stream[own[0] : own[-1]])
                    raw, bounds = ids.astype("<u4").tobytes(), begins[own - own[0]].tolist()
                    cells = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][at : at + 256], pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "ids"])
                del row, known, stream, edges, pools, start, length
                release_memory()

    whole = blocks.select("grp", "block", "doc_ids", "sizes", "stream", "n_words").join(back, "grp", "left")
    whole = whole.withColumn("lists", F.filter("found", lambda f: f["block"] == F.col("block")))
    made, more = (lambda batches: _decoding(ranks, "ids", reassemble(batches)), ", decoded BINARY") if decoded else (reassemble, "")
    return whole.select("doc_ids", "sizes", "stream", "n_words", "lists").mapInArrow(made, f"doc_id BIGINT, ids BINARY{more}").withColumnRenamed("doc_id", key)


def _decoding(ranks: str, ids: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with one more column, the bytes that its cells of ids stand for."""
    vocabulary = byte_vocabulary(ranks)
    for batch in batches:
        made = [None if cell is None else vocabulary.decode(np.frombuffer(cell, "<u4")) for cell in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])


def decode_ids(rows: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """The columns of `rows`, and the bytes that each cell of ids stands for."""
    kept = [c for c in rows.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "decoded")
    return rows.select(*kept).mapInArrow(lambda batches: _decoding(ranks, ids, batches), f"{schema}, decoded BINARY")
