"""Exact tokenisation of whole Arrow columns with word-level vocabularies.

A tokenizers-library JSON whose pre-tokenizer drops white space gives a text's ids as the ids of its
white-space-free chunks, one after the other: normalisation, splitting and merges never look across white
space. So a column is cut into chunks with numpy, equal chunks are found with Arrow's dictionary encoding,
and only distinct chunks are encoded; ids are put back together by array indexing. A chunk of printable
ASCII and Latin letters is split by the vocabulary's own pattern (RE2) and its distinct words are merged,
all at once, by the vocabulary's merge ranks. Any other chunk - other scripts, combining marks, special
strings, very long ones - goes to the library itself. Nothing is kept between batches, so memory is bounded
by a batch.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
LONGEST_WORD = 48
MOST_KNOWN = 200_000
LETTER, DIGIT, OTHER = 0, 1, 2
#: What the pattern tells apart, by code point of the plain characters.
LATIN_KIND = np.array([LETTER if (c := unicodedata.category(chr(i))[0]) == "L" else DIGIT if c == "N" else OTHER for i in range(0x180)], dtype=np.int8)
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Last two bytes of the UTF-8 forms of white space beyond ASCII; a cut after them could split a run of white space.
WIDE_SPACE_LAST = np.zeros(256, dtype=bool)
WIDE_SPACE_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
WIDE_SPACE_LEAD = np.zeros(256, dtype=bool)
WIDE_SPACE_LEAD[[0xC2, 0x9A, 0x80, 0x81]] = True
#: Chunks whose normal form is known: NFC leaves these characters alone and each lower-cases to one of them.
PLAIN = "^[!-~\u00a1-\u012f\u0131-\u0148\u014a-\u017e]*$"


class Ragged:
    """Rows of numbers: row i is pool[start[i] : start[i] + length[i]]."""

    def __init__(self, pool: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.pool, self.start, self.length = pool, start, length

    @classmethod
    def of(cls, rows: list) -> Ragged:
        length = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        pool = np.concatenate([np.asarray(r, dtype=np.uint32) for r in rows]) if len(rows) else np.empty(0, dtype=np.uint32)
        return cls(pool, np.cumsum(length) - length, length)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and where each begins (one more entry: the end)."""
        length = self.length[rows]
        ends = np.cumsum(length)
        begins = ends - length
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[rows] - begins, length)
        at += np.arange(total)
        return self.pool[at], np.append(begins, total)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, nulls as empty, and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each segment, distinct segments, first segment of each row and the end).

    A segment is a run of ASCII white space and the bytes after it up to the next such run.
    """
    data, offsets = as_bytes(texts)
    if not len(data):
        return np.empty(0, dtype=np.int32), pa.array([], type=pa.large_binary()), np.zeros(len(offsets), dtype=np.int64)
    begins = ASCII_SPACE[data]
    inner = ~begins[:-1]
    if (data >= 0x80).any():
        inner[1:] &= ~(WIDE_SPACE_LAST[data[1:-1]] & WIDE_SPACE_LEAD[data[:-2]])
    begins[1:] &= inner
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    bounds = np.append(at, len(data)).astype(np.int64)
    segments = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return segments.indices.to_numpy(), segments.dictionary, np.searchsorted(at, offsets)


class WordVocabulary:
    """Ids of texts by a tokenizers-library JSON of the word-end BPE kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["end_of_word_suffix"] is None or steps[0]["behavior"] != "Removed":
            raise ValueError("a vocabulary with word ends that drops white space is needed")
        self._forget()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = f"({steps[0]['pattern']['Regex']})"
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The characters that stand for the bytes, in byte order: asked of the library, since bytes 0xC2-0xF4 only occur inside characters.
        signs = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)]
        spare = iter(range(256, 512))
        signs = [s if s is not None else chr(next(spare)) for s in signs]
        if byte_level.pre_tokenize_str("é ~")[0][0] != "".join(signs[b] for b in "é ~".encode()):
            raise ValueError("the byte alphabet differs")
        self.inner = np.array([vocab.get(s, -1) for s in signs], dtype=np.int32)
        self.last = np.array([vocab.get(s + suffix, -1) for s in signs], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.mask = (1 << 19) - 1
        self.slot_key = np.full(self.mask + 1, -1, dtype=np.int64)
        self.slot_rank = np.full(self.mask + 1, NONE, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._hash(keys)
        while len(left):  # linear probing, a round for all keys that still have no slot
            free = self.slot_key[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.slot_key[at[won]], self.slot_rank[at[won]] = keys[left[won]], left[won]
            keep = np.ones(len(left), dtype=bool)
            keep[won] = False
            left, at = left[keep], (at[keep] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where there is none (or an id is negative)."""
        shape, a, b = a.shape, a.ravel(), b.ravel()
        out = np.full(len(a), NONE, dtype=np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[todo].astype(np.int64) << 20) | b[todo]
        at = self._hash(keys)
        while len(todo):
            found = self.slot_key[at]
            hit = found == keys
            out[todo[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (found != -1)
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & self.mask
        return out.reshape(shape)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Apply merges to each row (padded with -1) until none is left: always the lowest rank, leftmost first."""
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        done, rows = ids.copy(), np.arange(len(ids))
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            live = best != NONE
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                done[rows[~live], ids.shape[1] :] = -1
                ids, rank, rows, at, best = ids[live], rank[live], rows[live], at[live], best[live]
                if not len(rows):
                    return done
                width = max(2, int((ids >= 0).sum(axis=1).max()))
                ids, rank = ids[:, :width], rank[:, : width - 1]
            n, width = ids.shape
            each = np.arange(n)
            moved = np.empty_like(ids)
            moved[:, :-1] = np.where(np.arange(width - 1) > at[:, None], ids[:, 1:], ids[:, :-1])
            moved[:, -1] = -1
            moved[each, at] = self.merged[best]
            shifted = np.full_like(rank, NONE)
            shifted[:, :-1] = np.where(np.arange(width - 2) > at[:, None], rank[:, 1:], rank[:, :-1])
            after = np.where(at + 1 < width, moved[each, np.minimum(at + 1, width - 1)], -1)
            inside = at < width - 1
            shifted[each[inside], at[inside]] = self._rank(moved[each, at], after)[inside]
            before = at > 0
            shifted[each[before], at[before] - 1] = self._rank(moved[each[before], at[before] - 1], moved[each[before], at[before]])
            ids, rank = moved, shifted

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct words that the pattern has already split and lower case."""
        data, offsets = as_bytes(words)
        sizes = np.diff(offsets)
        start, length = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        pools, base = [], 0
        for least, most in ((1, 6), (7, 12), (13, 20), (21, LONGEST_WORD)):
            these = np.flatnonzero((sizes >= least) & (sizes <= most))
            if not len(these):
                continue
            cols = np.arange(max(most, 2))
            at = offsets[these][:, None] + cols
            inside = cols < sizes[these][:, None]
            raw = data[np.where(inside, at, 0)]
            ids = np.where(inside, self.inner[raw], -1)
            ids[np.arange(len(these)), sizes[these] - 1] = self.last[data[offsets[these] + sizes[these] - 1]]
            ids = self._merge(ids.astype(np.int32))
            there = ids >= 0
            length[these] = there.sum(axis=1)
            start[these] = base + np.cumsum(length[these]) - length[these]
            pools.append(ids[there].astype(np.uint32))
            base += len(pools[-1])
        for i in np.flatnonzero(sizes > LONGEST_WORD):
            found = self.library.encode(words[int(i)].as_py().decode(), add_special_tokens=False).ids
            start[i], length[i] = base, len(found)
            pools.append(np.array(found, dtype=np.uint32))
            base += len(found)
        return Ragged(np.concatenate(pools) if pools else np.empty(0, dtype=np.uint32), start, length)

    def _known_words(self, words: pa.Array) -> Ragged:
        """_words, remembering the ids of up to MOST_KNOWN words; then the memory starts anew."""
        names = words.to_pylist()
        at = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return Ragged(self.pool, self.start[at], self.length[at])
        found = self._words(words.take(pa.array(missing)))
        if len(self.known) + len(missing) <= MOST_KNOWN:
            base = len(self.start)
            self.start = np.concatenate([self.start, found.start + len(self.pool)])
            self.pool, self.length = np.concatenate([self.pool, found.pool]), np.concatenate([self.length, found.length])
            at[missing] = base + np.arange(len(missing))
            self.known.update(zip([names[i] for i in missing], at[missing].tolist()))
            return Ragged(self.pool, self.start[at], self.length[at])
        start, length = np.empty(len(names), dtype=np.int64), np.empty(len(names), dtype=np.int64)
        old = at >= 0
        start[old], length[old] = self.start[at[old]], self.length[at[old]]
        start[missing], length[missing] = found.start + len(self.pool), found.length
        both = Ragged(np.concatenate([self.pool, found.pool]), start, length)
        self._forget()
        return both

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.empty(0, dtype=np.uint32)
        self.start, self.length = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _split(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Runs of letters, single digits and runs of other signs of plain chunks without apostrophes, dictionary-encoded, and the first of each chunk."""
        data, offsets = as_bytes(text)
        if not len(data):
            return pa.array([], type=pa.large_binary()).dictionary_encode(), np.zeros(len(offsets), dtype=np.int64)
        kind = LATIN_KIND[data]
        lead = np.flatnonzero(data >= 0xC2)
        kind[lead] = LATIN_KIND[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        kind[lead + 1] = kind[lead]
        begins = np.empty(len(data), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[lead + 1] = False
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(begins)
        bounds = np.append(at, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return words.dictionary_encode(), np.searchsorted(at, offsets)

    def _split_by_pattern(self, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        spaced = pc.replace_substring_regex(text, self.pattern, r"\1 ")
        lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return lists.flatten().cast(pa.large_binary()).dictionary_encode(), np.append(0, np.cumsum(sizes))

    def chunks(self, distinct: pa.Array) -> Ragged:
        """Ids of distinct chunks."""
        text = pc.ascii_ltrim_whitespace(distinct.cast(pa.large_string()))
        plain = pc.match_substring_regex(text, PLAIN)
        for special in self.special:
            plain = pc.and_not(plain, pc.match_substring(text, special))
        plain = plain.to_numpy(zero_copy_only=False)
        start, length = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        quoted = pc.match_substring(text, "'").to_numpy(zero_copy_only=False)
        pools, base = [], 0
        for chosen, split in ((np.flatnonzero(plain & ~quoted), self._split), (np.flatnonzero(plain & quoted), self._split_by_pattern)):
            words, first = split(pc.utf8_lower(text.take(pa.array(chosen))))
            pool, begins = self._known_words(words.dictionary).gather(words.indices.to_numpy())
            start[chosen], length[chosen] = base + begins[first[:-1]], begins[first[1:]] - begins[first[:-1]]
            pools.append(pool)
            base += len(pool)
        pool = np.concatenate(pools)
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = Ragged.of([e.ids for e in self.library.encode_batch_fast(text.take(pa.array(rest)).to_pylist(), add_special_tokens=False)])
            start[rest], length[rest] = found.start + len(pool), found.length
            pool = np.concatenate([pool, found.pool])
        return Ragged(pool, start, length)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, where each row begins and the end)."""
        codes, distinct, first = cut(texts)
        ids, begins = self.chunks(distinct).gather(codes)
        return ids, begins[first]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        codes, distinct, first = cut(texts)
        sums = np.append(0, np.cumsum(self.chunks(distinct).length[codes]))
        return np.diff(sums[first])


@functools.lru_cache(maxsize=4)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def release_memory() -> None:
    """Hand freed memory back: a worker stays alive between stages, beside the next stage's workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20):
    """Parts of a batch of about `most` bytes of text at most (one row at least), for bounded memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
