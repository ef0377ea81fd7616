"""Media columns: texts as lossless WebP files, read back into pixel arrays.

A text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576, are the samples
of an image. Of the ways to lay them out the one with the least estimated bits is stored:

* grey pixels, a sample each; cross-colour takes red and blue away, and the predictor is
  used where the sample above tells the next one;
* a palette, where there are at most 16 different bytes: two to eight samples share a pixel;
* pairs of samples as red and green, with a colour cache of the commonest pairs, where a
  text is long enough to pay for its codes.

All have prefix codes made for them, and back-references. The width of an image tells grey
(64) from pairs (32). Files of more than 16384 rows do not exist, so a longer payload
becomes several files, one after the other.

The feature of a column is taken from the decoded samples: the mean, the mean step from one
block of 576 to the next, and the shares of 16 ranges of samples as hexadecimal digits.

Defined cases: null and empty texts have a payload of 576 bytes 255; repeated rows give
equal values; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import webp
from .common import prepare, table

BLOCK = 576
#: Pixels of a row of grey ones, and of pairs.
GREY, PAIRS = 64, 32
#: Different bytes up to which a palette packs several into a pixel.
FEW = 16
#: Samples from which pairs are tried, and bits of their colour cache.
LONG, CACHE_BITS = 32768, 9
#: Cross-colour multipliers that take green off red and blue: 32 / 32 of it.
GREY_CROSS = (32, 32, 0)


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def _bits(counts: np.ndarray) -> float:
    """What an ideal code of these counts takes."""
    c = counts[counts > 0]
    return float((c * (np.log2(c.sum()) - np.log2(c))).sum())


def _file(x: np.ndarray) -> bytes:
    """One file of samples, laid out in the way that should be the shortest."""
    counts = np.bincount(x, minlength=256)
    rows = x.reshape(-1, GREY)
    grey = (rows.astype("<u4") * 0x10101 | 0xFF000000).view(np.uint8).reshape(*rows.shape, 4)
    if np.count_nonzero(counts) <= FEW:
        return webp.write(grey, palette=True)
    plain = _bits(counts)
    if len(x) >= LONG:
        two = x.reshape(-1, 2)
        pair = two[:, 0].astype(np.uint32) << 8 | two[:, 1]
        common = np.sort(np.bincount(pair))[::-1]
        first = counts * (common[1 << CACHE_BITS - 1 :].sum() / len(x))
        # half the cache's places hold pairs for long; other pairs cost both their samples
        if _bits(np.concatenate((common[: 1 << CACHE_BITS - 1], first))) + first.sum() * plain / len(x) + 4000 < plain:
            image = np.zeros((len(two) // PAIRS, PAIRS, 4), np.uint8)
            image[..., 0], image[..., 1], image[..., 3] = two[:, 0].reshape(-1, PAIRS), two[:, 1].reshape(-1, PAIRS), 255
            return webp.write(image, cache_bits=CACHE_BITS)
    above = np.bincount((rows[1:] - rows[:-1]).reshape(-1), minlength=256)
    return webp.write(grey, predictor=_bits(above) < 0.9 * plain, cross=GREY_CROSS)


def store(data: bytes) -> bytes:
    """The files of a payload, joined."""
    x, most = np.frombuffer(data, np.uint8), GREY * webp.MAX_SIDE // BLOCK * BLOCK
    return b"".join(_file(x[i : i + most]) for i in range(0, len(x), most))


def load(media: bytes) -> np.ndarray:
    """The samples of joined files, BLOCK in a row."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        image = webp.decode(media[at:end])
        out.append(np.ascontiguousarray(image[..., :2] if image.shape[1] == PAIRS else image[..., 1]).reshape(-1, BLOCK))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def feature(rows: np.ndarray) -> str:
    flat = rows.reshape(-1)
    counts = np.bincount(flat >> 4, minlength=16)
    step = np.abs(np.diff(rows.astype(np.int16), axis=0)).mean() if len(rows) > 1 else 0.0
    return f"{len(rows)}:{flat.mean():.4f}:{step:.4f}:" + "".join(f"{int(x):x}" for x in np.ceil(15 * counts / len(flat)))


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, digests of the payload read back and of the stored form, and the feature."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]

    def one(text: bytes) -> tuple:
        media = store(payload(text))
        rows = load(media)
        back = rows.tobytes()
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(rows), media

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]
        for b in batches:
            # few rows at a time, for the stored forms may be as long as the texts
            for lo in range(0, b.num_rows, 32):
                part = b.slice(lo, 32)
                got = [one(t.as_py() or b"") for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in got], k) for i, k in enumerate(kinds))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", media binary" * keep_media)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
