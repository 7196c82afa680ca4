import hashlib
import struct
import zlib

import numpy as np
import pytest

from covertile.llm import media


def nearest(left, up, corner):
    return min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]


def filtered(samples, kinds, pixel):
    """A PNG with the given filter per row, made sample by sample."""
    rows = []
    for y, kind in enumerate(kinds):
        row, up = samples[y].astype(int), samples[y - 1].astype(int) if y else np.zeros(samples.shape[1], int)
        left, corner = np.r_[np.zeros(pixel, int), row[:-pixel]], np.r_[np.zeros(pixel, int), up[:-pixel]]
        guess = [0 * row, left, up, (left + up) // 2, np.array([nearest(a, b, c) for a, b, c in zip(left, up, corner, strict=True)])][kind]
        rows.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", samples.shape[1] // pixel, len(samples), 8, {1: 0, 3: 2, 4: 6}[pixel], 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x") + media._chunk(b"IDAT", zlib.compress(b"".join(rows))) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("pixel", [1, 3, 4])
def test_all_filters_are_undone(pixel):
    rnd = np.random.default_rng(pixel)
    samples = rnd.integers(0, 256, (12, 24), np.uint8)
    for kinds in ([0, 1, 2, 3, 4] * 2 + [2, 2], [2] * 12, [1] * 12, [4] * 12, [3] * 12):
        assert np.array_equal(media.decode_png(filtered(samples, kinds, pixel))[0], samples)


def test_own_files_round_trip_and_damage_is_seen():
    samples = np.random.default_rng(1).integers(0, 256, (9, 192), np.uint8)
    data = media.encode_png(samples)
    assert np.array_equal(media.decode_png(data)[0], samples)
    for bad, why in ((b"", "signature"), (data[:-6], "truncated"), (data[:50] + bytes([data[50] ^ 1]) + data[51:], "checksum"), (data[:40], "truncated")):
        with pytest.raises(media.MediaError, match=why):
            media.decode_png(bad)


def test_cosine_hash_is_the_transform():
    image = np.random.default_rng(2).random((32, 32)) * 255
    low = np.array([[sum(image[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    assert media.perceptual_hash(np.repeat(image[:, :, None], 1, 2).reshape(32, 32), 1) == np.packbits(bits).tobytes().hex()


def test_texts(spark):
    rows = [(0, None, "x"), (1, "", "y"), (2, "é" * 500, None), (3, "a" * 192, "z"), (4, "a" * 193, "z"), (5, "a" * 193, "z"), (6, "long " * 40_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = {r["doc_id"]: r for r in media.read_media(media.store_texts(df)).collect()}
    for i, text, _ in rows:
        raw = (text or "").encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = out[i]
        assert bytes(r["payload"]) == want and r["n_bytes"] == len(raw) and r["error"] is None and len(r["feature"]) == 16
        assert hashlib.sha256(bytes(r["media"])).digest()
    assert bytes(out[4]["media"]) == bytes(out[5]["media"]) and out[4]["feature"] == out[5]["feature"]
    assert media.store_texts(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "id int, media binary")
    assert [r["error"] for r in media.read_media(broken).orderBy("id").collect()] == ["no signature", "no signature"]


def chunked(head, body):
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", body) + media._chunk(b"IEND", b"")


def test_malformed_files_give_an_error_row(spark):
    form = lambda width, height, *rest: struct.pack(">IIBBBBB", width, height, *(rest or (8, 2, 0, 0, 0)))
    whole = zlib.compress(bytes(193))
    files = [None, b"", b"x", chunked(form(0, 0), zlib.compress(b"")), chunked(form(0, 2), zlib.compress(b"\0\0")), chunked(b"short", whole), chunked(form(64, 1), whole[:-4]), chunked(form(64, 1), whole[:-1] + b"?"), chunked(form(64, 1), b""), chunked(form(64, 1, 8, 2, 1, 0, 0), whole), chunked(form(64, 2), whole)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate([*files, chunked(form(64, 1), whole)])], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in media.read_media(df).collect()}
    assert all(rows[i]["payload"] is None and rows[i]["feature"] is None and rows[i]["error"] for i in range(len(files)))
    assert rows[len(files)]["error"] is None and bytes(rows[len(files)]["payload"]) == bytes(192)
    assert media.read_media(df.limit(0)).count() == 0


def test_all_filters_equal_a_loop():
    rnd = np.random.default_rng(5)
    for pixel, width, height in ((3, 5, 9), (1, 7, 4), (4, 1, 6)):
        rows = rnd.integers(0, 256, (height, width * pixel)).astype(np.uint8)
        kinds = rnd.integers(0, 5, height).astype(np.uint8)
        kinds[:3] = 4, 3, 4
        want = np.zeros((height + 1, width * pixel + pixel), int)
        for y in range(height):
            for x in range(width * pixel):
                left, up, corner = want[y + 1, x], want[y, x + pixel], want[y, x]
                want[y + 1, x + pixel] = (int(rows[y, x]) + (0, left, up, (left + up) // 2, nearest(left, up, corner))[kinds[y]]) % 256
        assert np.array_equal(media.unfilter(rows, kinds, pixel), want[1:, pixel:])
