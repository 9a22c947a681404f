"""PNG media columns: encode bytes as 8-bit PNG, decode with checksum tests, hash low frequencies.

Every chunk's CRC and the zlib stream's checksum are tested on reading. Each row is stored by the
filter that suits it best, and the five filters are undone with numpy, along the anti-diagonals of
all images of a batch at once. Images are binary columns, and so is the 64-bit cosine-transform hash.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quern.llm.common import by_batch, id_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type (grey, RGB, grey + alpha, RGBA).
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 576
PAD = 255
MAX_PIXELS_SIDE = 2**31 - 1


class BadImage(ValueError):
    """The bytes aren't a PNG this module reads, or a checksum of theirs is wrong."""


def pad_payload(data: bytes, multiple: int = WIDTH) -> bytes:
    """data and bytes 255 up to a positive multiple."""
    return data + bytes([PAD]) * ((-len(data)) % multiple if data else multiple)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: bytes, width: int = WIDTH, color: int = 0, row_filter: int | None = None, level: int = 6) -> bytes:
    """A PNG of 8-bit samples, at least one row; each row is filtered by the one of the five filters
    whose differences, as signed bytes, have the least sum of magnitudes (ties: the lowest number),
    or all rows by row_filter."""
    step = SAMPLES[color]
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width * step)
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    left, corner = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], corner[:, step:] = rows[:, :-step], up[:, :-step]

    def filtered(kind: int) -> np.ndarray:
        if kind == 3:
            return rows - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
        if kind == 4:
            return rows - _nearest(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
        return rows - (left if kind == 1 else up) if kind else rows

    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    if row_filter is not None:
        lines[:, 0], lines[:, 1:] = row_filter, filtered(row_filter)
    else:
        least = np.full(len(rows), 1 << 62)
        for kind in range(5):
            found = filtered(kind)
            size = np.minimum(found, -found).sum(axis=1, dtype=np.int64)  # of a byte and its negative, the magnitude is the lesser
            better = size < least
            least[better] = size[better]
            lines[better, 0], lines[better, 1:] = kind, found[better]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _nearest(a, b, c):
    """Of left, up and upper left, the one nearest to left + up - upper left; ties in that order."""
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def decode_png(data: bytes) -> np.ndarray:
    """Rows x width x samples; BadImage on any wrong length, checksum, order or unknown kind."""
    image = decode_pngs([data])[0]
    if isinstance(image, BadImage):
        raise image
    return image


def decode_pngs(images: list[bytes]) -> list[np.ndarray | BadImage]:
    """decode_png of each, or its error; the filters of all images are undone together."""
    out: list = []
    for data in images:
        try:
            out.append(_filtered_rows(data))
        except BadImage as e:
            out.append(e)
    good = [k for k, x in enumerate(out) if not isinstance(x, BadImage)]
    for k, image in zip(good, unfiltered([out[k] for k in good])):
        out[k] = image
    return out


def _filtered_rows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Filter of each row; rows x width x samples, still filtered."""
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise BadImage("cut short")
        chunk = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(chunk, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk) if n == 13 else None
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadImage(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended:
        raise BadImage("no header" if head is None else "no end")
    width, height, depth, color, *rest = head
    if depth != 8 or color not in SAMPLES or rest != [0, 0, 0] or not width or not height:
        raise BadImage("unsupported kind of image")
    step = SAMPLES[color]
    line = width * step + 1
    undo = zlib.decompressobj()
    try:
        raw = undo.decompress(b"".join(body), height * line + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != height * line or not undo.eof:
        raise BadImage("wrong amount of data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, line)
    if lines[:, 0].max() > 4:
        raise BadImage("unknown row filter")
    return lines[:, 0], lines[:, 1:].reshape(height, width, step)


def unfiltered(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Samples of images (filter of each row, filtered rows x width x samples).

    A sample needs the one to its left, the one above and the one between them, so all samples of an
    anti-diagonal are known at once: step t takes column t - y of every row y, of every image.
    """
    out: list = [None] * len(images)
    by_width: dict[int, list[int]] = {}
    for k, (_, rows) in enumerate(images):
        by_width.setdefault(rows.shape[1], []).append(k)
    for width, group in by_width.items():
        # Each channel of a row is a line of its own.
        lines = np.concatenate([images[k][1].transpose(0, 2, 1).reshape(-1, width) for k in group])
        shapes = [(len(images[k][1]), images[k][1].shape[2]) for k in group]
        kind = np.concatenate([np.repeat(images[k][0], c) for k, (_, c) in zip(group, shapes)])
        y = np.concatenate([np.repeat(np.arange(h), c) for h, c in shapes])
        channels = np.concatenate([np.full(h * c, c) for h, c in shapes])
        order = np.argsort(y, kind="stable")
        # By row number, with a line of zeros at the end that stands above every first row.
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y))
        number = np.arange(len(y))
        above = np.where(y > 0, place[np.maximum(number - channels, 0)], len(y))[order]
        samples = np.zeros((len(y) + 1, width), np.int16)
        samples[:-1] = lines[order]
        _undo(samples, kind[order], y[order], above)
        lines = samples[place].astype(np.uint8)
        at = 0
        for k, (h, c) in zip(group, shapes):
            out[k] = np.ascontiguousarray(lines[at : at + h * c].reshape(h, c, width).transpose(0, 2, 1))
            at += h * c
    return out


def _undo(samples: np.ndarray, kind: np.ndarray, y: np.ndarray, above: np.ndarray) -> None:
    """In place; lines by rising row number y, above: the line over each."""
    width, flat = samples.shape[1], samples.ravel()
    own, high = np.arange(len(y)) * width - y, above * width - y
    left, corner = np.zeros(len(y), np.int16), np.zeros(len(y), np.int16)
    is_left, is_up, is_mean, is_near = (kind == k for k in (1, 2, 3, 4))
    steps = np.arange(int(y[-1]) + width)
    first, last = np.searchsorted(y, steps - width, "right"), np.searchsorted(y, steps, "right")
    for t, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        at = own[a:b] + t
        l, u, c = left[a:b], flat[high[a:b] + t], corner[a:b]
        guess = is_left[a:b] * l + is_up[a:b] * u + is_mean[a:b] * ((l + u) >> 1) + is_near[a:b] * _nearest(l, u, c)
        now = (flat[at] + guess) & 255
        flat[at] = now
        left[a:b], corner[a:b] = now, u


@lru_cache
def _cosines(n: int, keep: int) -> np.ndarray:
    k = np.arange(keep)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


def low_frequency_hash(image: np.ndarray, side: int = 32, keep: int = 8) -> bytes:
    """keep x keep bits: the low-frequency cosine terms of the grey image, shrunk to side x side
    cell means, above their median or not. An image smaller than the grid repeats its nearest rows."""
    gray = image[..., : 3 if image.shape[2] > 2 else 1].astype(np.float64).mean(axis=2)
    for axis in (0, 1):
        n = gray.shape[axis]
        edges = np.arange(side) * n // side
        widths = np.maximum(1, np.diff(np.append(edges, n)))
        gray = np.add.reduceat(gray, edges, axis=axis) / (widths[:, None] if axis == 0 else widths)
    c = _cosines(side, keep)
    low = np.round(c @ gray @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame, level: int = 6, row_filter: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded to whole rows, as a grey PNG.

    Null and empty texts give one row of padding; repeated rows give equal images; the length is
    bounded by a task's memory only (a few times the longest text).
    """

    def rows(c: dict) -> dict:
        data = [(t or "").encode() for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [len(d) for d in data], "media": [encode_png(pad_payload(d), row_filter=row_filter, level=level) for d in data]}

    return by_batch(id_text(docs), rows, "doc_id bigint, n_bytes bigint, media binary")


def decode_media(media: DataFrame, *carry: str) -> DataFrame:
    """Adds to (doc_id, n_bytes, media) the samples read back (payload), feature and error.

    A null image gives nulls; one that fails a test gives null payload and feature, and the error.
    """

    def rows(c: dict) -> dict:
        found = iter(decode_pngs([x for x in c["media"] if x is not None]))
        payload, feature, error = [], [], []
        for x in c["media"]:
            image = None if x is None else next(found)
            good = image is not None and not isinstance(image, BadImage)
            payload.append(image.tobytes() if good else None)
            feature.append(low_frequency_hash(image) if good else None)
            error.append(str(image) if image is not None and not good else None)
        return c | {"payload": payload, "feature": feature, "error": error}

    return by_batch(media.select("doc_id", "n_bytes", "media"), rows, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature binary, error string")
