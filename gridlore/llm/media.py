"""Operator 5: PNG columns, written, checked, read back and fingerprinted in numpy.

``to_png`` stores bytes losslessly as an 8-bit grey image (64 samples a row) in a binary column.
``from_png`` walks the chunks of such a column, tests every checksum, inflates the image data and
undoes the row filters (all five of the format); ``cosine_hash`` keeps the signs of the lowest
frequencies of a 32 x 32 reduction.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlore.llm.common import table, text_or_empty

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Most bytes of image data in one chunk.
_CHUNK = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A grey PNG of ``samples``, a positive multiple of ``width``; one filter for all rows, the one
    of None, Sub and Up whose differences are smallest."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    sub, up = image.copy(), image.copy()
    sub[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    forms = (image, sub, up)
    kind = int(np.argmin([np.abs(f.view(np.int8).astype(np.int16)).sum(dtype=np.int64) for f in forms]))
    lines = np.empty((len(image), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, forms[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[k : k + _CHUNK]) for k in range(0, len(packed), _CHUNK))
    return _MAGIC + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters: whole runs of rows at once, but sample by sample for Average and Paeth."""
    out = lines.copy()
    height, width = out.shape
    flat = kinds == 1
    out[flat] = np.cumsum(lines[flat], axis=1, dtype=np.uint8)
    row = 0
    while row < height:
        kind, end = kinds[row], row + 1
        while end < height and kinds[end] == kind:
            end += 1
        above = out[row - 1] if row else np.zeros(width, np.uint8)
        if kind == 2:
            out[row:end] = np.cumsum(np.vstack((above[None, :], lines[row:end])), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(row, end):
                b = (out[y - 1] if y else above).astype(int).tolist()
                x, left, corner, done = lines[y].astype(int).tolist(), 0, 0, []
                for k in range(width):
                    if kind == 3:
                        guess = (left + b[k]) // 2
                    else:
                        p = left + b[k] - corner
                        d = (abs(p - left), abs(p - b[k]), abs(p - corner))
                        guess = left if d[0] <= d[1] and d[0] <= d[2] else b[k] if d[1] <= d[2] else corner
                    left, corner = (x[k] + guess) & 255, b[k]
                    done.append(left)
                out[y] = done
        row = end
    return out


def png_samples(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, rows by columns; ValueError where anything is wrong."""
    if png[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(data) < size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("no end, or not 8-bit grey without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    width, height = head[:2]
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if height and lines[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return _unfilter(lines[:, 0], lines[:, 1:])


_SIDE, _LOW = 32, 8
_COS = np.rint(4096 * np.cos(np.pi / _SIDE * (np.arange(_SIDE)[None, :] + 0.5) * np.arange(_LOW)[:, None])).astype(np.int64)


def _reduced(image: np.ndarray) -> np.ndarray:
    """Means (x 256) over 32 even bands of rows; rows repeat where there are fewer."""
    n = len(image)
    edge = np.arange(_SIDE) * n // _SIDE
    total = np.add.reduceat(image.astype(np.int64), edge, axis=0)
    count = np.maximum(np.diff(np.append(edge, n)), 1)
    return (total << 8) // count[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed their median. In integers, so
    that every machine gets the same."""
    small = _reduced(_reduced(image).T).T
    low = (_COS @ small @ _COS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: bytes, unit: int = WIDTH) -> bytes:
    """``text`` and zeros up to a positive multiple of ``unit``."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes in ``column``."""
    size = np.cumsum([len(x) for x in batch.column(column).cast(pa.large_binary()).to_numpy(zero_copy_only=False)])
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, "right")))
        yield batch.slice(row, end - row)
        row = end


def to_png(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``png``, the stored form of each row's text; null texts are empty, and an empty text
    is one row of zeros. Repeated rows and repeated or null doc_ids are rows of their own, equal texts have
    equal images. Other columns are ignored; an empty table gives no rows."""

    def run(batches):
        for whole in batches:
            for batch in _parts(whole, "text"):
                texts = [t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array((png_bytes(payload(t)) for t in texts), pa.binary())],
                    ["doc_id", "n_bytes", "png"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, png binary")


def png_features(images: DataFrame) -> DataFrame:
    """Read ``png`` back: size and digests of payload and stored form, and the hash (``phash``, and in
    hexadecimal ``feature``). A damaged image fails the job with the reason.
    One row for each row of ``images``; columns other than doc_id, n_bytes and png are not read."""

    def run(batches):
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "phash"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for whole in batches:
            for batch in _parts(whole, "png"):
                rows = []
                for scalar in batch.column("png"):
                    png = scalar.as_py()
                    image = png_samples(png)
                    back, mark = image.tobytes(), cosine_hash(image)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), mark.hex(), mark))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    kind = images.schema["doc_id"].dataType.simpleString()
    return images.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary",
    )


def op5_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_features(to_png(table(spark, sf_dir, "documents"))).drop("phash")
