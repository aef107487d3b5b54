"""Codecs of payloads: stored, zstd (with a dictionary), xz; and dictionary training."""

from __future__ import annotations

import lzma
from collections.abc import Iterable

import zstandard

from .errors import CodecError

# Fixed values of the format: codec numbers in a type byte's high nibble, and training's limits.
CODECS = {0x00: "stored", 0x10: "zstd", 0x20: "xz"}
NUMBERS = {v: k for k, v in CODECS.items()}
SAMPLE, TIMES, DICTIONARY = 4096, 100, 32 * 1024


def codec_name(number: int) -> str:
    """The codec's name; one that isn't known stays readable as metadata."""
    return CODECS.get(number, f"?{number:x}?")


def compress(data: bytes, codec: str, level: int | None = None, dictionary: bytes | None = None) -> bytes:
    if codec == "stored":
        return data
    if codec == "zstd":
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=3 if level is None else level, **extra).compress(data)
    if codec == "xz":
        return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, 6 if level is None else level)
    raise CodecError(f"codec {codec} isn't supported")


def decompress(data: bytes, codec: str, dictionary: bytes | None = None) -> bytes:
    """The content; a frame that isn't finished is an error."""
    if codec == "stored":
        return data
    try:
        if codec == "zstd":
            extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            reader = zstandard.ZstdDecompressor(**extra).decompressobj()
            out = reader.decompress(data)
            if not reader.eof:
                raise CodecError("zstd payload is cut off")
            return out
        if codec == "xz":
            reader = lzma.LZMADecompressor(lzma.FORMAT_XZ)
            out = reader.decompress(data)
            if not reader.eof:
                raise CodecError("xz payload is cut off")
            return out
    except (zstandard.ZstdError, lzma.LZMAError) as e:
        raise CodecError(f"{codec} payload doesn't decode ({e})") from None
    raise CodecError(f"codec {codec} isn't supported")


def train(samples: Iterable[bytes], size: int = DICTIONARY) -> bytes | None:
    """A zstd dictionary, or none where the samples are too few."""
    cut = [s[:SAMPLE] for s in samples if s]
    if not cut or sum(map(len, cut)) < TIMES * size:
        return None
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except zstandard.ZstdError:
        return None
