"""Decoding from the middle of a stream."""

from __future__ import annotations

from glyphlake.functions import deflate


def replay(stream: bytes, bit: int, history: bytes, count: int) -> tuple[bytes, str]:
    """``count`` bytes of output from a block boundary at a bit of the stream, with the output before it as history; what zlib refuses is decoded bit by bit, to say why."""
    out, at, last = bytearray(history), bit, False
    while not last and len(out) < len(history) + count:
        block = deflate.block_output(stream, at, max(len(stream) - 4, 0), bytes(out[-deflate.WINDOW :]), len(history) + count - len(out))
        if block is None:
            return _replay_bits(stream, bit, history, count)
        part, at, last = block
        out += part
    return bytes(out[len(history) : len(history) + count]), ""


def _replay_bits(stream: bytes, bit: int, history: bytes, count: int) -> tuple[bytes, str]:
    out = deflate.Trace(data=bytearray(history))
    bits, last = deflate._Bits(stream, 0, max(len(stream) - 4, 0)), False
    bits.at = bit
    want, error = len(history) + count, ""
    try:
        while not last and len(out.data) < want:
            last = bool(bits.take(1, "input exhausted before the requested output"))
            kind = bits.take(2, "input exhausted before the requested output")
            if kind == 0:
                bits.at = (bits.at + 7) & ~7
                n = bits.take(16, "input exhausted before the requested output")
                bits.take(16, "input exhausted before the requested output")
                at = bits.at >> 3
                out.data += stream[at : at + n]
                bits.at += 8 * n
            elif kind == 3:
                error = "inflate failed during extraction"
                break
            else:
                pair = deflate.fixed() if kind == 1 else deflate._dynamic(bits, out, 0)
                deflate._output(bits, out, *pair, want)
    except deflate._Stop as e:
        if str(e) != "output cap exceeded":
            error = str(e)
        elif len(out.data) < want:
            # The last match reached over the end: take from it what was wanted.
            while len(out.data) < want:
                out.data.append(out.data[-out.pending])
    return bytes(out.data[len(history) : want]), error

