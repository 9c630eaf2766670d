import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest_texts import IDS, TEXTS
from webloom.llm import byte_bpe, id_files, packing, token_counts
from webloom.llm.subword import word_vocabulary
from webloom.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORD)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
BYTES = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = st.text(alphabet=st.one_of(st.sampled_from("abAB'st 09\n\t\r\x1c\x85\xa0 　́éÉİſß½漢😀<|>_.,"), st.characters(exclude_categories=["Cs"])), max_size=80)


def word_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_word_vocabulary_is_the_library(texts):
    texts = [*texts, "<|endoftext|>it's", None]
    ids, begins = word_vocabulary(WORD).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [word_ids(t) for t in texts]
    assert word_vocabulary(WORD).count(pa.array(texts)).tolist() == [len(word_ids(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_byte_words_are_the_library(texts):
    stream, begins, words = byte_bpe.split_words(pa.array(texts), byte_bpe.word_pattern(public_tokenizers.PATTERN))
    encode = byte_bpe.byte_vocabulary(BYTE).encode_word
    assert [[i for c in stream[a:b] for i in encode(words[c])] for a, b in zip(begins, begins[1:])] == [BYTES.encode_ordinary(t) for t in texts]


def test_byte_bpe(docs, none):
    encoded = byte_bpe.encode_texts(docs, BYTE, public_tokenizers.PATTERN)
    found = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in byte_bpe.decode_ids(encoded, BYTE).collect()), key=repr)
    assert found == sorted(((i, BYTES.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(IDS, TEXTS)), key=repr)
    assert byte_bpe.encode_texts(none, BYTE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_many_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 500)
    monkeypatch.setattr(byte_bpe, "GROUP", 3)
    many = docs.unionByName(spark.range(400).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("row "), F.repeat(F.concat("id", F.lit(" é\n")), 20)).alias("text")), allowMissingColumns=True).coalesce(2)
    rows = many.select("doc_id", "text").collect()
    found = byte_bpe.encode_texts(many, BYTE, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in found), key=repr) == sorted(((r["doc_id"], BYTES.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in rows), key=repr)


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r["decoded"] for r in byte_bpe.decode_ids(rows, BYTE).collect()] == [None, b""]
    with pytest.raises(ValueError):
        byte_bpe.byte_vocabulary(BYTE).decode(np.array([50256]))


def test_token_counts_and_cache(spark, docs, none):
    cache = scratch_path(spark, "cache")
    assert token_counts.count_tokens(none, cache, WORD).count() == 0
    want = sorted(((i, len((t or "").encode()), len(word_ids(t))) for i, t in zip(IDS, TEXTS)), key=repr)
    for _ in range(2):
        assert sorted((tuple(r) for r in token_counts.count_tokens(docs, cache, WORD).collect()), key=repr) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == 7  # one for each normalised text, none added by the second run
    stored.select("version", "digest", (F.col("n_tokens") * 0 + 77).alias("n_tokens")).write.partitionBy("version").parquet(cache + "2")
    assert {r["n_tokens"] for r in token_counts.count_tokens(docs, cache + "2", WORD).collect()} == {77}  # the cache is what answers


def test_id_files(spark, docs, none):
    path = scratch_path(spark, "ids")
    id_files.write_ids(docs, path, WORD, end_id=1)
    rows = id_files.read_ids(spark, path, ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 5, 6, 7, 8, 9]
    start = 0
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()))
        start += r["n_tokens"]
    assert sorted((r["ids"] for r in rows)) == sorted(word_ids(t) + [1] for t in TEXTS)
    id_files.write_ids(none, path + "0", WORD, end_id=1)
    assert id_files.read_ids(spark, path + "0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.data())
def test_blocks_round_trip(ids, data):
    content = id_files.write_part([7, None], np.array([len(ids), 0]), np.array(ids, dtype=np.uint32))
    keys, counts, back = id_files.read_part(content)
    assert (keys, counts.tolist(), back.tolist()) == ([7, None], [len(ids), 0], ids)
    if ids:
        first = data.draw(st.integers(0, len(ids) - 1))
        count = data.draw(st.integers(1, len(ids) - first))
        assert id_files.read_span(content, first, count).tolist() == ids[first : first + count]


def check_packing(pieces, texts, capacity):
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and 0 < length <= capacity
            at += length
        assert at <= capacity
    want = [(i, p, p * capacity, ids[p * capacity : (p + 1) * capacity]) for i, t in texts for ids in [word_ids(t) + [1]] for p in range(-(-len(ids) // capacity))]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces), key=repr)
    assert got == sorted(((i, p, s, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, p, s, x in want), key=repr)
    return len(bins)


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORD, end_id=1, capacity=512).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, list(zip(IDS, TEXTS)), 512) == -(-total // 512)
    assert packing.pack_documents(none, WORD, end_id=1).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plans(capacity, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=80)), dtype=np.int64)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.make_plan(dict(zip(values.tolist(), counts.tolist())), capacity)
    ranks = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.empty(0, dtype=np.int64)
    bins = plan.assign(np.repeat(values, counts), ranks)
    filled = np.bincount(bins, weights=np.repeat(values, counts), minlength=plan.bins) if len(bins) else np.empty(0)
    assert (filled <= capacity).all() and (filled > 0).all() and plan.bins <= len(lengths)


def test_plan_is_near_the_volume_bound():
    lengths = np.minimum(4096, np.exp(np.random.default_rng(1).normal(6.2, 1, 20000)).astype(int) + 1)
    values, counts = np.unique(lengths, return_counts=True)
    assert packing.make_plan(dict(zip(values.tolist(), counts.tolist())), 4096).bins <= 1.01 * lengths.sum() / 4096 + 1


def test_digest_keeps_versions_apart(tmp_path):
    (tmp_path / "a").write_bytes(b"a")
    assert token_counts.tokenizer_version(str(tmp_path / "a")) == hashlib.sha256(b"a").hexdigest()
