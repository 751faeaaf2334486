import struct
import zlib

import numpy as np
import pytest

from lexloom.sources import documents as sources
from lexloom.sources import images


def png(image, kinds=(0,)):
    """An image as PNG, the rows filtered by the kinds in turn."""
    x = image.reshape(image.shape[0], image.shape[1], -1).astype(np.int64)
    rows = []
    for y, row in enumerate(x):
        up = x[y - 1] if y else np.zeros_like(row)
        left, corner = np.roll(row, 1, 0), np.roll(up, 1, 0)
        left[0] = corner[0] = 0
        kind = kinds[y % len(kinds)]
        near = (0, left, up, (left + up) // 2, images._paeth(left, up, corner))[kind]
        rows.append(bytes([kind]) + ((row - near) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def page(angle=0.0, size=160):
    """Dark lines of a page, turned by an angle."""
    y, x = np.mgrid[:size, :size] - size / 2
    a = np.deg2rad(angle)
    u, v = x * np.cos(a) + y * np.sin(a), -x * np.sin(a) + y * np.cos(a)
    return np.where((abs(u) < 60) & (abs(v) < 40) & ((v // 8) % 2 == 0), 30, 220).astype(np.uint8)


def test_png():
    rng = np.random.RandomState(0)
    for image in (rng.randint(0, 256, (13, 9)), rng.randint(0, 256, (11, 7, 3))):
        assert (images.read_png(png(image, (0, 1, 2, 3, 4))) == image).all()
    for broken in (b"", b"text", png(page())[:40]):
        with pytest.raises((ValueError, zlib.error)):
            images.read_png(broken)


def test_steps():
    rng = np.random.RandomState(1)
    x = page()
    noisy = np.clip(x + rng.normal(0, 12, x.shape), 0, 255).astype(np.uint8)
    assert abs(images.denoise(noisy, 15.0).astype(int) - x).mean() < 0.6 * abs(noisy.astype(int) - x).mean()
    assert set(np.unique(images.black_and_white(noisy))) == {0, 255} and (images.black_and_white(np.full((40, 40), 99, np.uint8)) == 255).all()
    assert images.grey(np.full((2, 2, 3), 80, np.uint8)).tolist() == [[80, 80], [80, 80]]


@pytest.mark.parametrize("angle", [-20.0, -3.0, 0.2, 6.0, 30.0])
def test_straight(angle):
    turned = page(angle)
    assert abs(images.skew(turned) - angle) < 1.0
    assert abs(images.skew(images.straighten(turned))) < 1.0
    assert images.skew(np.full((9, 9), 255, np.uint8)) == 0.0


def test_clean_pages_of_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(page(4.0, 96), (2,)))
    (tmp_path / "b.png").write_bytes(b"no image")
    load = sources.ocr_extractor(None, images.read_png, images.clean, lambda image, lang, config: f"{image.shape} {abs(images.skew(image)) < 1.5}")
    got = {r.path.rpartition("/")[2]: (r.success, r.text) for r in sources.extract_documents(sources.files(spark, str(tmp_path)), load).collect()}
    assert got == {"a.png": (True, "(96, 96) True"), "b.png": (False, "")}
