"""Clean-up of page images before text recognition, in numpy: grey, without noise, black and white, straight.

The steps are what :func:`~lexloom.sources.documents.ocr_extractor` takes as ``read_image`` and
``clean``. Images are arrays of bytes, rows x columns or rows x columns x 3.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np


def read_png(content: bytes) -> np.ndarray:
    """An image of 8 bits a channel without interlacing: grey, or colours, transparency left out. Raises for any other file."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif kind == b"IDAT":
            data.append(content[at + 8 : at + 8 + size])
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unknown kind of PNG")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a border of zeros before the first row and column
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, channels).astype(np.int64)
        above = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 2:
            out[y + 1, 1:] = (line + above) & 255
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        else:
            for x in range(width):
                left, up, corner = out[y + 1, x], above[x], out[y, x]
                near = (left + up) // 2 if kind == 3 else _paeth(left, up, corner)
                out[y + 1, x + 1] = (line[x] + near) & 255
    image = out[1:, 1:].astype(np.uint8)
    return image[..., 0] if channels < 3 else image[..., :3]


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour that is closest to left + up - corner."""
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.round(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _box(x: np.ndarray, size: int) -> np.ndarray:
    """The sum over a square around each pixel, of an array with a border of ``size // 2``."""
    total = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def denoise(image: np.ndarray, strength: float = 10.0, patch: int = 7, window: int = 21) -> np.ndarray:
    """Non-local means: every pixel becomes the mean of those in a window, weighted by how alike their patches are."""
    half, reach = patch // 2, window // 2
    x = np.pad(image.astype(np.float64), half + reach, mode="reflect")
    rows, cols = image.shape
    centre = x[reach : reach + rows + 2 * half, reach : reach + cols + 2 * half]
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(window):
        for dx in range(window):
            other = x[dy : dy + rows + 2 * half, dx : dx + cols + 2 * half]
            w = np.exp(-_box((centre - other) ** 2, patch) / (patch * patch * strength * strength))
            total += w * other[half : half + rows, half : half + cols]
            weight += w
    return np.round(total / weight).astype(np.uint8)


def black_and_white(image: np.ndarray, size: int = 31, below: float = 10.0) -> np.ndarray:
    """White where a pixel is brighter than the Gaussian mean around it less ``below``, else black."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    mean = np.pad(image.astype(np.float64), size // 2, mode="edge")
    for axis in (0, 1):
        mean = np.apply_along_axis(np.convolve, axis, mean, kernel / kernel.sum(), "valid")
    return np.where(image > mean - below, 255, 0).astype(np.uint8)


def skew(image: np.ndarray, dark: int = 128) -> float:
    """By how many degrees, from -45 to 45, the smallest rectangle around the dark pixels is turned; 0 without any."""
    y, x = np.nonzero(image < dark)
    if len(y) < 3:
        return 0.0
    # only the first and last dark pixel of a row can be corners
    first = np.flatnonzero(np.diff(y, prepend=-1))
    ends = np.unique(np.concatenate([first, np.append(first[1:], len(y)) - 1]))
    points = np.stack([x[ends], y[ends]], 1).astype(np.float64)
    angles = np.deg2rad(np.arange(-45, 45, 0.1))
    along, across = (points @ np.stack(c) for c in ((np.cos(angles), np.sin(angles)), (-np.sin(angles), np.cos(angles))))
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    return float(np.rad2deg(angles[area.argmin()]))


def straighten(image: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Turned back by its :func:`skew`, unless that is less than ``least`` degrees; cubic, the border repeated."""
    angle = skew(image)
    if abs(angle) < least:
        return image
    rows, cols = image.shape
    cy, cx, a = rows // 2, cols // 2, np.deg2rad(angle)
    y, x = np.mgrid[:rows, :cols].astype(np.float64)
    sx, sy = (x - cx) * np.cos(a) - (y - cy) * np.sin(a) + cx, (x - cx) * np.sin(a) + (y - cy) * np.cos(a) + cy
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(image.shape)
    for i in range(-1, 3):
        for j in range(-1, 3):
            w = _cubic(sy - fy - i) * _cubic(sx - fx - j)
            out += w * image[np.clip(fy + i, 0, rows - 1), np.clip(fx + j, 0, cols - 1)]
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))


def clean(image: np.ndarray) -> np.ndarray:
    """All steps in order."""
    return straighten(black_and_white(denoise(grey(image))))
