import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlore.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payloads_come_back(data):
    samples = media.payload(data)
    assert len(samples) % 64 == 0 and len(samples) >= 64 and samples[: len(data)] == data and not any(samples[len(data) :])
    assert media.png_samples(media.png_bytes(samples)).tobytes() == samples


def filtered(image, kinds):
    """A PNG whose rows have the given filters, by the format's definition."""
    height, width = image.shape
    x = image.astype(int)
    raw = bytearray()
    for y in range(height):
        raw.append(kinds[y])
        for k in range(width):
            a, b = (x[y, k - 1] if k else 0), (x[y - 1, k] if y else 0)
            c = x[y - 1, k - 1] if y and k else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw.append((x[y, k] - (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(bytes(raw))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


def test_all_five_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (23, 17)).astype(np.uint8)
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 0, 2, 3, 4, 1, 2, 2, 4, 3, 0, 4, 2]
    assert (media.png_samples(filtered(image, kinds)) == image).all()


@pytest.mark.parametrize("at", [0, 20, 30, 60, -3])
def test_damage_is_found(at):
    png = bytearray(media.png_bytes(media.payload(b"some text " * 40)))
    png[at] ^= 1
    with pytest.raises(ValueError):
        media.png_samples(bytes(png))
    with pytest.raises(ValueError):
        media.png_samples(bytes(png[:-12]))


def test_hash_is_the_sign_of_low_frequencies():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (32, 64)).astype(np.uint8)
    small = image.reshape(32, 32, 2).mean(axis=2)
    cos = np.cos(np.pi / 32 * (np.arange(32)[None, :] + 0.5) * np.arange(8)[:, None])
    low = (cos @ small @ cos.T).ravel()
    plain = low > np.median(low[1:])
    bits = np.unpackbits(np.frombuffer(media.cosine_hash(image), np.uint8)).astype(bool)
    assert (plain != bits).sum() <= 2  # integers round where the float form does not
    brighter = (image // 2 + 60).astype(np.uint8)
    changed = np.unpackbits(np.frombuffer(media.cosine_hash(brighter), np.uint8)).astype(bool)
    assert (changed != bits).sum() <= 6


def test_columns_of_odd_rows(docs, odd_rows):
    found = media.png_features(media.to_png(docs(odd_rows))).collect()
    expected = []
    for doc, text in odd_rows:
        raw = (text or "").encode()
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        expected.append((doc, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in found), key=key) == sorted(expected, key=key)
    by_payload: dict = {}
    for r in found:
        by_payload.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
        assert r["phash"].hex() == r["feature"]
    assert all(len(x) == 1 for x in by_payload.values())
    assert media.png_features(media.to_png(docs([]))).count() == 0
