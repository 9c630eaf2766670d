"""Compact text codings of bytes, texts and postings, and the 64-bit address hash."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of base 85, and start and factor of the 64-bit FNV-1a hash.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%()*+-./;=?@^_~[]{}|"
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
_VALUE = {d: i for i, d in enumerate(DIGITS)}


def base85_encode(raw: bytes) -> str:
    """Four bytes, most significant first, as five digits; a tail of k bytes as k + 1."""
    tail = -len(raw) % 4
    numbers = struct.unpack(f">{(len(raw) + tail) // 4}I", raw + bytes(tail))
    digits = "".join(DIGITS[n // 85**4] + DIGITS[n // 85**3 % 85] + DIGITS[n // 85**2 % 85] + DIGITS[n // 85 % 85] + DIGITS[n % 85] for n in numbers)
    return digits[: len(digits) - tail]


def base85_decode(digits: str) -> bytes | None:
    """Null for what no bytes encode to."""
    tail = -len(digits) % 5
    if tail == 4 or not set(digits) <= _VALUE.keys():
        return None
    numbers, padded = [], digits + DIGITS[-1] * tail
    for at in range(0, len(padded), 5):
        n = 0
        for d in padded[at : at + 5]:
            n = n * 85 + _VALUE[d]
        if n >> 32:
            return None
        numbers.append(n)
    raw = struct.pack(f">{len(numbers)}I", *numbers)
    return raw[: len(raw) - tail]


def pack_text(text: str, dictionary: bytes = b"") -> str:
    """Raw deflate, with a preset dictionary if given, in base 85."""
    extra = {"zdict": dictionary} if dictionary else {}
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15, **extra)
    return base85_encode(deflate.compress(text.encode()) + deflate.flush())


def unpack_text(packed: str, dictionary: bytes = b"") -> str | None:
    raw = base85_decode(packed)
    if raw is None:
        return None
    extra = {"zdict": dictionary} if dictionary else {}
    try:
        inflate = zlib.decompressobj(-15, **extra)
        text = inflate.decompress(raw) + inflate.flush()
    except zlib.error:
        return None
    return text.decode("utf-8", "replace") if inflate.eof else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def pack_postings(pairs: list[tuple[int, int]]) -> str:
    """Ascending (document, weight) pairs as varints of gaps and weights, in base 85."""
    out, before = [], 0
    for doc, tf in pairs:
        out += [_varint(doc - before), _varint(tf)]
        before = doc
    return base85_encode(b"".join(out))


def unpack_postings(packed: str) -> list[tuple[int, int]] | None:
    raw = base85_decode(packed)
    if raw is None:
        return None
    numbers, n, shift = [], 0, 0
    for byte in raw:
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            numbers.append(n)
            n = shift = 0
    if shift or len(numbers) % 2:
        return None
    pairs, doc = [], 0
    for gap, tf in zip(numbers[::2], numbers[1::2]):
        doc += gap
        pairs.append((doc, tf))
    return pairs


def _mapped(f, kind: str):
    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return apply


def packed_text(text: Column, dictionary: bytes = b"") -> Column:
    return _mapped(lambda t: pack_text(t, dictionary), "string")(text)


def unpacked_text(packed: Column, dictionary: bytes = b"") -> Column:
    return _mapped(lambda p: unpack_text(p, dictionary), "string")(packed)


def packed_postings(pairs: Column) -> Column:
    """From ARRAY<STRUCT<doc_id, tf>> in ascending order."""
    return _mapped(lambda rows: pack_postings([(int(r["doc_id"]), int(r["tf"])) for r in rows]), "string")(pairs)


def unpacked_postings(packed: Column) -> Column:
    return _mapped(lambda s: None if (p := unpack_postings(s)) is None else [{"doc_id": d, "tf": t} for d, t in p], "array<struct<doc_id:bigint,tf:bigint>>")(packed)


def stored_text(plain: Column, packed: Column, dictionary: bytes = b"") -> Column:
    """Full text of a stored page: the packed one if there is one and it can be read, else the plain one."""
    return F.coalesce(unpacked_text(F.nullif(packed, F.lit("")), dictionary), plain)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits, on two 32-bit halves since no signed product may overflow."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(F.hex(text)), F.lit(2)), lambda i: F.conv(F.substring(F.hex(text), i, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(FNV_START >> 32).cast("bigint").alias("high"), F.lit(FNV_START & 0xFFFFFFFF).cast("bigint").alias("low"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")

    def step(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        product = low * F.lit(FNV_FACTOR & 0xFFFFFFFF)
        high = acc["high"] * F.lit(FNV_FACTOR & 0xFFFFFFFF) + low * F.lit(FNV_FACTOR >> 32) + F.shiftrightunsigned(product, 32)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    def finish(acc: Column) -> Column:
        return F.concat(F.lpad(F.lower(F.hex(acc["high"])), 8, "0"), F.lpad(F.lower(F.hex(acc["low"])), 8, "0"))

    return F.when(F.octet_length(text) == 0, f"{FNV_START:016x}").otherwise(F.aggregate(bytes_, start, step, finish))
