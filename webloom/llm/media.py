"""Binary media columns: PNG images made and read with zlib and numpy, and low-frequency cosine hashes of them.

Reading walks the chunks, tests each checksum, joins the data chunks, inflates them and undoes the row filters with
numpy: `none` rows at once, `sub` rows as running sums along all of them, `up` rows as running sums down each stretch of
them, `average` and `paeth` rows pixel by pixel across the row. Eight-bit grey, grey-alpha, RGB and RGBA without
interlacing are read; anything else, and any damage, is reported in an error column and never raised.

The hash shrinks the grey image to 32 x 32 by averaging, takes the cosine transform and keeps one bit for each of the
8 x 8 lowest frequencies: whether it is above their median. Similar images differ in few bits.

Defined results. Null text: as an empty one, 64 zero bytes. Equal texts give equal images and hashes. Very long texts are
images of many rows, one in memory at a time. Null and repeated ids: a row each. Empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NO_FILTER, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
LEVEL = 4
SIDE, LOW = 32, 8
_K, _X = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
COSINES = np.cos(np.pi * (2 * _X + 1) * _K / (2 * SIDE))[:LOW]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """A grey or multi-channel 8-bit image (rows, columns[, channels]) as PNG; each row takes the filter of `none`, `sub` and `up` with the smallest sum of magnitudes."""
    rows = pixels.reshape(pixels.shape[0], -1)
    depth = 1 if pixels.ndim == 2 else pixels.shape[2]
    sub, up = rows.copy(), rows.copy()
    sub[:, depth:] -= rows[:, :-depth]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    weight = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = weight.argmin(axis=0)
    data = np.empty((len(rows), rows.shape[1] + 1), dtype=np.uint8)
    data[:, 0], data[:, 1:] = best, tried[best, np.arange(len(rows))]
    kind = {n: k for k, n in CHANNELS.items()}[depth]
    header = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(data.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    if content[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(content):
        if at + 12 > len(content):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", content, at)
        kind, body, end = content[at + 4 : at + 8], content[at + 8 : at + 8 + size], at + 12 + size
        if end > len(content):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", content, end - 4)[0]:
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')} is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise ValueError("no end chunk")


def unfilter(kinds: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Undo the row filters: `rows` are the filtered bytes, `kinds` each row's filter."""
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown row filter")
    out = rows.copy()
    sub = kinds == SUB
    if sub.any():
        out[sub] = np.cumsum(rows[sub].reshape(int(sub.sum()), -1, depth), axis=1, dtype=np.uint8).reshape(int(sub.sum()), -1)
    # Stretches of equal filters; those that look at the row above are done from the top down.
    edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])).tolist() + [len(kinds)]
    for first, last in zip(edges, edges[1:]):
        kind = kinds[first]
        if kind == UP:
            stretch = rows[first:last].copy()
            if first:
                stretch[0] += out[first - 1]
            out[first:last] = np.cumsum(stretch, axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for y in range(first, last):
                above = out[y - 1].astype(np.int64) if y else np.zeros(rows.shape[1], dtype=np.int64)
                line = out[y]
                for x in range(0, rows.shape[1], depth):
                    here = slice(x, x + depth)
                    a = line[x - depth : x].astype(np.int64) if x else np.zeros(depth, dtype=np.int64)
                    b, c = above[here], above[x - depth : x] if x else np.zeros(depth, dtype=np.int64)
                    if kind == AVERAGE:
                        guess = (a + b) // 2
                    else:
                        to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                        guess = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
                    line[here] = (rows[y, here] + guess) & 0xFF
    return out


def decode_png(content: bytes) -> np.ndarray:
    """The image's samples as (rows, columns, channels); ValueError for what is damaged or not supported."""
    header, data = None, []
    for kind, body in _chunks(content):
        if header is None and kind != b"IHDR":
            raise ValueError("the header is not first")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif not kind[0] & 0x20 and kind not in (b"PLTE", b"IEND"):
            raise ValueError("an unknown critical chunk")
    if header is None:
        raise ValueError("no header")
    width, height, bits, colour, packing, filtering, interlace = header
    if bits != 8 or colour not in CHANNELS or packing or filtering or interlace or not width or not height:
        raise ValueError("this kind of PNG is not supported")
    depth = CHANNELS[colour]
    try:
        raw = zlib.decompressobj().decompress(b"".join(data), height * (width * depth + 1) + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * depth + 1):
        raise ValueError("the data has another size than the header says")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(height, -1)
    return unfilter(lines[:, 0], lines[:, 1:], depth).reshape(height, width, depth)


def _shrink(grey: np.ndarray, axis: int) -> np.ndarray:
    size = grey.shape[axis]
    if size < SIDE:
        return np.take(grey, np.arange(SIDE) * size // SIDE, axis=axis)
    edges = np.arange(SIDE + 1) * size // SIDE
    shape = [1, 1]
    shape[axis] = SIDE
    return np.add.reduceat(grey, edges[:-1], axis=axis) / np.diff(edges).reshape(shape)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """Eight bytes from the lowest frequencies of an image (rows, columns, channels)."""
    grey = pixels.mean(axis=2) if pixels.shape[2] > 1 else pixels[:, :, 0].astype(np.float64)
    low = COSINES @ _shrink(_shrink(grey, 0), 1) @ COSINES.T
    return np.packbits(low.ravel() > np.median(low)).tobytes()


def text_pixels(text: bytes) -> np.ndarray:
    """UTF-8 bytes as rows of WIDTH samples, zeros after the end, one row at least."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return np.frombuffer(text.ljust(size, b"\0"), dtype=np.uint8).reshape(-1, WIDTH)


def text_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a PNG in a binary column."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                media = pa.array([encode_png(text_pixels(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(map(len, texts), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(store, "doc_id BIGINT, n_bytes BIGINT, media BINARY")


READ = "payload_bytes BIGINT, payload_sha256 STRING, tail_crc32 BIGINT, media_bytes BIGINT, media_sha256 STRING, feature STRING, error STRING"


def image_features(images: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of `images`, then what reading each image back gives; a null or damaged image has an error and no payload."""
    names = [c for c in images.columns if c != media and c not in {x.split()[0] for x in READ.split(", ")}]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*names).schema] + [READ])

    def one(content: bytes | None) -> tuple:
        if content is None:
            return None, None, None, None, None, None, "no image"
        stored = len(content), hashlib.sha256(content).hexdigest()
        try:
            pixels = decode_png(content)
        except ValueError as e:
            return None, None, None, *stored, None, str(e)
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, cosine_hash(pixels).hex(), None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(media)]
            made = [pa.array(column, kind) for column, kind in zip(zip(*found) if found else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *(x.split()[0] for x in READ.split(", "))])

    return images.select(*names, media).mapInArrow(read, schema)
