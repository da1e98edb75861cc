"""Scanlines: passes, reverse filters, samples."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First column, first row, column step and row step of the seven passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
FILTERS = ("none", "sub", "up", "average", "paeth")
MAX_SIDE, MAX_DECODED = 1 << 28, 1 << 34


def layout(width: int, height: int, depth: int, color: int, interlace: bool) -> list[dict] | None:
    """Passes with sizes in bytes; None for sides of zero or formats that no sample layout has."""
    if width <= 0 or height <= 0 or color not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        return None
    out = []
    for k, (x0, y0, dx, dy) in enumerate(PASSES if interlace else ((0, 0, 1, 1),)):
        w, h = max(0, -(-(width - x0) // dx)), max(0, -(-(height - y0) // dy))
        if not w or not h:
            w = h = 0
        row = (w * CHANNELS[color] * depth + 7) // 8
        out.append({"pass": k, "width": w, "height": h, "x_start": x0, "y_start": y0, "x_step": dx, "y_step": dy, "row_bytes": row, "filter_row_bytes": row + 1 if w else 0, "total_bytes": (row + 1) * h if w else 0})
    return out


def bytes_per_pixel(depth: int, color: int) -> int:
    return max(1, (CHANNELS[color] * depth + 7) // 8)


def predict(kind: int, a: int, b: int, c: int) -> int:
    """What a filter expects from the left, upper and upper left bytes."""
    if kind == 1:
        return a
    if kind == 2:
        return b
    if kind == 3:
        return (a + b) >> 1
    if kind == 4:
        p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        return a if p <= q and p <= r else b if q <= r else c
    return 0


def unfilter(kind: int, row: bytes, above: bytes, bpp: int) -> bytes:
    """A row without its filter; none, sub and up as array sums, the others byte after byte."""
    if kind == 0:
        return row
    x = np.frombuffer(row, np.uint8)
    if kind == 2:
        return (x + np.frombuffer(above, np.uint8)).tobytes()
    if kind == 1:
        wide = np.zeros(-(-len(x) // bpp) * bpp, np.uint8)
        wide[: len(x)] = x
        return np.cumsum(wide.reshape(-1, bpp), axis=0, dtype=np.uint8).tobytes()[: len(x)]
    out = bytearray(row)
    for i, v in enumerate(row):
        a, c = (out[i - bpp], above[i - bpp]) if i >= bpp else (0, 0)
        b = above[i]
        if kind == 3:
            out[i] = (v + ((a + b) >> 1)) & 255
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = (v + (a if p <= q and p <= r else b if q <= r else c)) & 255
    return bytes(out)


@dataclass
class Stages:
    success: bool = False
    error: str = ""
    filtered: bytes = b""
    unfiltered: bytes = b""
    scanlines: list[dict] = field(default_factory=list)
    passes: list[dict] = field(default_factory=list)
    samples: np.ndarray | None = None


def inflate(stream: bytes, cap: int) -> tuple[bytes, str]:
    """Inflated bytes up to ``cap`` and how it ended: ended, capped, truncated or corrupt."""
    d = zlib.decompressobj()
    try:
        data = d.decompress(stream, cap + 1) if cap < 2**31 else d.decompress(stream)
    except zlib.error:
        return b"", "corrupt"
    if len(data) > cap:
        return data[:cap], "capped"
    return data, "ended" if d.eof else "truncated"


def unpack(rows: list[bytes], width: int, channels: int, depth: int) -> np.ndarray:
    """Samples (rows, width, channels) of packed rows."""
    n = width * channels
    if depth == 16:
        s = np.stack([np.frombuffer(r, ">u2")[:n] for r in rows]).astype(np.int32)
    elif depth == 8:
        s = np.stack([np.frombuffer(r, np.uint8)[:n] for r in rows]).astype(np.int32)
    else:
        bits = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in rows]), axis=1)[:, : n * depth].reshape(len(rows), n, depth)
        s = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.int32)
    return s.reshape(len(rows), width, channels)


def pack(samples: np.ndarray, depth: int) -> bytes:
    rows = samples.reshape(len(samples), -1)
    if depth == 16:
        return rows.astype(">u2").tobytes()
    if depth == 8:
        return rows.astype(np.uint8).tobytes()
    bits = (rows[..., None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(len(rows), -1).astype(np.uint8), axis=1).tobytes()


def filtered(stream: bytes, width: int, height: int, depth: int, color: int, interlace: bool) -> tuple[list[dict], bytes, str]:
    """Passes, inflated bytes and what is wrong with them, up to their filter bytes."""
    if width > MAX_SIDE or height > MAX_SIDE or (passes := layout(width, height, depth, color, interlace)) is None or sum(p["total_bytes"] for p in passes) > MAX_DECODED:
        return [], b"", "invalid image header"
    total = sum(p["total_bytes"] for p in passes)
    data, end = inflate(stream, total)
    if end in ("truncated", "corrupt"):
        return passes, data, "inflate: stream did not reach end"
    if end == "capped" or len(data) != total:
        return passes, data, "inflate: inflated size does not match the scanline layout"
    at = 0
    for p in passes:
        if p["total_bytes"] and max(data[at : at + p["total_bytes"] : p["filter_row_bytes"]]) > 4:
            return passes, data, "invalid filter byte"
        at += p["total_bytes"]
    return passes, data, ""


def analyze(stream: bytes, width: int, height: int, depth: int, color: int, interlace: bool, plain: bool = True) -> Stages:
    """Every stage of an image, or the first error; without ``plain`` scanlines as they are, and no samples."""
    out = Stages()
    passes, out.filtered, out.error = filtered(stream, width, height, depth, color, interlace)
    if out.error and out.error != "invalid filter byte":
        return out
    channels, bpp, at, stream_row = CHANNELS[color], bytes_per_pixel(depth, color), 0, 0
    target = np.zeros((height, width, channels), np.int32) if plain else None
    for p in passes:
        above, rows = bytes(p["row_bytes"]), []
        for k in range(p["height"]):
            kind = out.filtered[at]
            if kind > 4:
                out.error = "invalid filter byte"
                return out
            row = out.filtered[at + 1 : at + p["filter_row_bytes"]]
            line = {"stream_row": stream_row, "pass": p["pass"], "row_in_pass": k, "offset": at, "length": p["filter_row_bytes"], "filter_type": kind, "filtered": row}
            out.scanlines.append(line)
            at, stream_row = at + p["filter_row_bytes"], stream_row + 1
            if plain:
                line["above"] = above
                line["unfiltered"] = above = unfilter(kind, row, above, bpp)
                rows.append(above)
        if rows:
            target[p["y_start"] :: p["y_step"], p["x_start"] :: p["x_step"]] = unpack(rows, p["width"], channels, depth)
    out.passes, out.samples, out.success = passes, target, True
    if plain:
        out.unfiltered = pack(target, depth)
    return out


def events(kind: int, row: bytes, plain: bytes, above: bytes, bpp: int) -> list[dict]:
    """One step a byte: raw, left, upper, upper left, predictor, result."""
    out = []
    for i, v in enumerate(row):
        a, c = (plain[i - bpp], above[i - bpp]) if i >= bpp else (0, 0)
        out.append({"idx": i, "raw": v, "a": a, "b": above[i], "c": c, "predictor": predict(kind, a, above[i], c), "recon": plain[i]})
    return out
