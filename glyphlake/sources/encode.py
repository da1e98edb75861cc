"""A PNG encoder for fixtures and for tables carried as images.

It shares no code with the decoder: filters run forward on whole arrays, and
Deflate streams are written by zlib or bit by bit.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Start and step of the seven interlace passes: x0, y0, dx, dy.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
LEGAL_PAIRS = ((1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (1, 3), (2, 3), (4, 3), (8, 3), (8, 4), (16, 4), (8, 6), (16, 6))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def ihdr(width: int, height: int, depth: int, color: int, interlace: int = 0) -> bytes:
    return struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)


def pack_rows(samples: np.ndarray, depth: int) -> np.ndarray:
    """(height, width * channels) samples as (height, bytes) of rows, the most significant bit first."""
    if depth == 16:
        return np.ascontiguousarray(samples.astype(">u2")).view(np.uint8)
    if depth == 8:
        return samples.astype(np.uint8)
    bits = (samples[..., None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(len(samples), -1).astype(np.uint8), axis=1)


def filter_row(kind: int, row: bytes, above: bytes, bpp: int) -> bytes:
    x, b = (np.frombuffer(v, np.uint8).astype(np.int16) for v in (row, above))
    a, c = np.zeros_like(x), np.zeros_like(x)
    if len(x) > bpp:
        a[bpp:], c[bpp:] = x[:-bpp], b[:-bpp]
    if kind == 0:
        p = 0
    elif kind == 1:
        p = a
    elif kind == 2:
        p = b
    elif kind == 3:
        p = (a + b) >> 1
    else:
        e = a + b - c
        pa, pb, pc = abs(e - a), abs(e - b), abs(e - c)
        p = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    return bytes([kind]) + ((x - p) & 255).astype(np.uint8).tobytes()


#: Bytes of rows that are filtered at once.
FILTER_BYTES = 1 << 20


def filter_rows(rows: np.ndarray, bpp: int, rotating: bool, first: int = 0) -> bytes:
    """filter_row() of all rows, the five kinds in turn from the first on, or none, as array sums over many rows."""
    n = rows.shape[1]
    if not rotating:
        return np.pad(rows, ((0, 0), (1, 0))).tobytes()
    out, step = [], max(5, FILTER_BYTES // max(n, 1) // 5 * 5)
    for k in range(0, len(rows), step):
        part = np.zeros((min(step, len(rows) - k) + 1, n + bpp), np.uint8)
        part[1:, bpp:] = rows[k : k + step]
        if k:
            part[0, bpp:] = rows[k - 1]
        done = np.empty((len(part) - 1, n + 1), np.uint8)
        for i in range(min(5, len(done))):
            kind, x, to = (first + i) % 5, part[i + 1 :: 5, bpp:], done[i::5, 1:]
            done[i::5, 0] = kind
            if kind == 0:
                to[:] = x
            elif kind < 3:
                np.subtract(x, part[i + 1 :: 5, :n] if kind == 1 else part[i:-1:5, bpp:], out=to)  # modulo 256
            else:
                a, b = part[i + 1 :: 5, :n].astype(np.int16), part[i:-1:5, bpp:].astype(np.int16)
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    c = part[i:-1:5, :n].astype(np.int16)
                    pa, pb = b - c, a - c
                    pc = np.abs(pa + pb)
                    np.abs(pa, out=pa)
                    np.abs(pb, out=pb)
                    p = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                np.subtract(x, p.astype(np.uint8), out=to)
        out.append(done.tobytes())
    return b"".join(out)


def filtered_stream(samples: np.ndarray, depth: int, color: int, interlace: bool = False, rotating: bool = True) -> bytes:
    """Pass by pass, each row with its filter byte; samples are (height, width, channels)."""
    bpp = max(1, CHANNELS[color] * depth // 8)
    out, count = [], 0
    for x0, y0, dx, dy in ADAM7 if interlace else ((0, 0, 1, 1),):
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        rows = pack_rows(part.reshape(part.shape[0], -1), depth)
        out.append(filter_rows(rows, bpp, rotating, count))
        count += len(rows)
    return b"".join(out)


def stored_stream(data: bytes) -> bytes:
    """A zlib stream of stored blocks of up to 65535 bytes."""
    out = b"\x78\x01"
    parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    for i, p in enumerate(parts):
        out += bytes([i == len(parts) - 1]) + struct.pack("<HH", len(p), len(p) ^ 0xFFFF) + p
    return out + struct.pack(">I", zlib.adler32(data))


def literal_stream(data: bytes) -> bytes:
    """A zlib stream of one fixed-Huffman block without matches."""
    bits = [1, 1, 0]
    for v in data:
        code, n = (0x30 + v, 8) if v < 144 else (0x190 + v - 144, 9)
        bits += [code >> k & 1 for k in range(n - 1, -1, -1)]
    bits += [0] * 7
    return b"\x78\x01" + np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes() + struct.pack(">I", zlib.adler32(data))


def zlib_stream(data: bytes, level: int = -1, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 15, 8, strategy)
    return c.compress(data) + c.flush()


def png(header: bytes, stream: bytes, split: int | None = None, palette: bytes | None = None) -> bytes:
    whole, seed = len(stream) // split * split if split else 0, zlib.crc32(b"IDAT")
    head = struct.pack(">I", split or 0) + b"IDAT"
    parts = [head + (p := stream[i : i + split]) + zlib.crc32(p, seed).to_bytes(4, "big") for i in range(0, whole, split or 1)]
    if not split or whole < len(stream):
        parts.append(chunk(b"IDAT", stream[whole:]))
    return SIGNATURE + chunk(b"IHDR", header) + (chunk(b"PLTE", palette) if palette else b"") + b"".join(parts) + chunk(b"IEND", b"")


def palette_of(depth: int) -> bytes:
    return b"".join(bytes([(3 * i + 1) & 255, (5 * i + 2) & 255, (7 * i + 3) & 255]) for i in range(1 << depth))


def pattern(width: int, height: int, depth: int, color: int, seed: int = 7) -> np.ndarray:
    """Deterministic samples (height, width, channels), none of them zero."""
    y, x, c = np.meshgrid(np.arange(height), np.arange(width), np.arange(CHANNELS[color]), indexing="ij")
    if depth < 8:
        return (1 + (3 * x + 5 * y + seed) % ((1 << depth) - 1 or 1)).clip(0, (1 << depth) - 1)
    value = [1 + (3 * x + 5 * y + 7 * c + seed + 11 * k) % 255 for k in range(depth // 8)]
    return value[0] if depth == 8 else value[0] * 256 + value[1]


def image(width: int, height: int, depth: int, color: int, interlace: bool = False, rotating: bool = True, seed: int = 7, split: int | None = None) -> tuple[bytes, np.ndarray]:
    """A patterned file and its samples."""
    s = pattern(width, height, depth, color, seed)
    stream = zlib_stream(filtered_stream(s, depth, color, interlace, rotating))
    return png(ihdr(width, height, depth, color, int(interlace)), stream, split, palette_of(depth) if color == 3 else None), s


def gray_bytes(data: bytes, width: int = 16) -> tuple[int, np.ndarray]:
    """Bytes as 8-bit gray samples of ``width`` columns, padded with zeros; at least one row."""
    height = max(1, -(-len(data) // width))
    return height, np.frombuffer(data.ljust(height * width, b"\0"), np.uint8).reshape(height, width, 1)
