"""Digests and codecs of texts and bytes."""

from __future__ import annotations

import zlib

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def sha1(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def sha2(c: Column, bits: int = 256) -> Column:
    return F.sha2(c.cast("binary"), bits)


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def xxh64(c: Column) -> Column:
    """XXH64 of the bytes with seed 42, as Spark hashes a string, in 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.xxhash64(c.cast("string")))), 16, "0")


@F.pandas_udf(T.StringType())
def xxh64_zero(c: pd.Series) -> pd.Series:
    """XXH64 of a text's bytes with seed 0, in hexadecimal."""
    return c.map(lambda x: None if x is None else xxhash.xxh64_hexdigest(x.encode() if isinstance(x, str) else x))


@F.pandas_udf(T.StringType())
def xxh32_zero(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else xxhash.xxh32_hexdigest(x.encode() if isinstance(x, str) else x))


@F.pandas_udf(T.LongType())
def adler32(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else zlib.adler32(x.encode() if isinstance(x, str) else x)).astype("Int64")


@F.pandas_udf(T.StringType())
def fnv1a_64(c: pd.Series) -> pd.Series:
    """64-bit FNV-1a in hexadecimal."""

    def one(x):
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in x.encode() if isinstance(x, str) else x:
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return c.map(one)


def to_base64(c: Column) -> Column:
    return F.base64(c.cast("binary"))


def from_base64(c: Column) -> Column:
    return F.unbase64(c)


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def encrypt(c: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_encrypt(c.cast("binary"), key.cast("binary"), F.lit(mode))


def decrypt(c: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(c, key.cast("binary"), F.lit(mode))


def codec(name: str, compress: bool = True):
    """A function of a binary column that compresses or decompresses it: deflate, gzip, zlib, bz2, lzma or zstd."""

    @F.pandas_udf(T.BinaryType())
    def run(c: pd.Series) -> pd.Series:
        import bz2
        import gzip
        import lzma

        import zstandard

        raw = lambda b: (lambda o: o.compress(b) + o.flush())(zlib.compressobj(9, zlib.DEFLATED, -15))
        both = {
            "deflate": (raw, lambda b: zlib.decompress(b, -15)), "zlib": (zlib.compress, zlib.decompress), "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
            "bz2": (bz2.compress, bz2.decompress), "lzma": (lzma.compress, lzma.decompress), "zstd": (zstandard.compress, zstandard.decompress),
        }
        f = both[name][0 if compress else 1]
        return c.map(lambda x: None if x is None else f(bytes(x)))

    return run
