"""A Deflate decoder that keeps what every bit and byte stands for.

Token and table bits count from the end of the zlib header, block bits from its
beginning.  Errors are values: nothing here raises on malformed input.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass, field

# Base and extra bits of length symbols 257-285 and distance symbols 0-29, and the order of code lengths.
LENGTHS = ((3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0), (11, 1), (13, 1), (15, 1), (17, 1), (19, 2), (23, 2), (27, 2), (31, 2), (35, 3), (43, 3), (51, 3), (59, 3), (67, 4), (83, 4), (99, 4), (115, 4), (131, 5), (163, 5), (195, 5), (227, 5), (258, 0))
DISTANCES = ((1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (7, 1), (9, 2), (13, 2), (17, 3), (25, 3), (33, 4), (49, 4), (65, 5), (97, 5), (129, 6), (193, 6), (257, 7), (385, 7), (513, 8), (769, 8), (1025, 9), (1537, 9), (2049, 10), (3073, 10), (4097, 11), (6145, 11), (8193, 12), (12289, 12), (16385, 13), (24577, 13))
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
#: Bytes of a stream that will be traced.
MAX_INPUT = 64 << 20
WINDOW = 32768


@dataclass
class Token:
    kind: str
    input_bit_begin: int
    input_bit_end: int
    output_begin: int
    output_end: int
    literal: int = 0
    length: int = 0
    distance: int = 0
    match_source_begin: int = 0
    match_source_end: int = 0
    sources: list = field(default_factory=list)
    block: int = 0


@dataclass
class Trace:
    success: bool = False
    error: str = ""
    deflate_data_begin: int = 0
    data: bytearray = field(default_factory=bytearray)
    tokens: list[Token] = field(default_factory=list)
    blocks: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    #: Distance of the match that the output cap cut off.
    pending: int = 0


class _Stop(Exception):
    pass


class _Bits:
    """Bits from the least significant on."""

    def __init__(self, data: bytes, begin: int, end: int):
        self.data, self.at, self.end = data, begin * 8, end * 8
        self.begin = begin * 8

    def left(self) -> int:
        return self.end - self.at

    def peek(self, n: int) -> int:
        """The next n bits (up to 16), zeros beyond the end."""
        k = self.at >> 3
        return (int.from_bytes(self.data[k : min(k + 4, self.end >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int, error: str) -> int:
        if self.left() < n:
            raise _Stop(error)
        v = self.peek(n)
        self.at += n
        return v

    def where(self) -> int:
        return self.at - self.begin


class Huffman:
    """A canonical code; ``find`` maps the next bits to (symbol, length)."""

    def __init__(self, lengths: list[int], incomplete: bool):
        self.lengths = lengths
        self.codes = [0] * len(lengths)
        self.most = max(lengths, default=0)
        if self.most > 15:
            raise _Stop("huffman code length exceeds the table limit")
        counts = [0] * 16
        for n in lengths:
            counts[n] += n > 0
        room = 1
        for n in range(1, 16):
            room = (room << 1) - counts[n]
            if room < 0:
                raise _Stop("oversubscribed huffman tree")
        if room and not (incomplete and self.most <= 1):
            raise _Stop("incomplete huffman tree")
        code, first = 0, [0] * 16
        for n in range(1, 16):
            code = (code + counts[n - 1]) << 1
            first[n] = code
        self.table: list = [None] * (1 << self.most) if self.most else []
        for symbol, n in enumerate(lengths):
            if n:
                self.codes[symbol] = first[n]
                back = int(f"{first[n]:0{n}b}"[::-1], 2)
                for k in range(back, 1 << self.most, 1 << n):
                    self.table[k] = (symbol, n)
                first[n] += 1

    def read(self, bits: _Bits, name: str) -> int:
        hit = self.table[bits.peek(self.most)] if self.most else None
        if hit is None:
            raise _Stop(f"truncated {name}" if bits.left() < max(self.most, 1) else f"invalid {name}")
        if hit[1] > bits.left():
            raise _Stop(f"truncated {name}")
        bits.at += hit[1]
        return hit[0]


_FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


@functools.cache
def fixed() -> tuple[Huffman, Huffman]:
    """The two codes of fixed blocks."""
    return Huffman(_FIXED, False), Huffman([5] * 32, False)


def _entries(code: Huffman, spans: list[tuple[int, int]]) -> list[dict]:
    return [{"symbol": s, "bit_length": n, "canonical_code": code.codes[s], "prov_begin": a, "prov_end": z} for s, (n, (a, z)) in enumerate(zip(code.lengths, spans)) if n]


def _dynamic(bits: _Bits, out: Trace, block: int) -> tuple[Huffman, Huffman]:
    literals = bits.take(5, "truncated dynamic header") + 257
    distances = bits.take(5, "truncated dynamic header") + 1
    count = bits.take(4, "truncated dynamic header") + 4
    lengths, spans = [0] * 19, [(0, 0)] * 19
    for k in CODE_ORDER[:count]:
        a = bits.where()
        lengths[k] = bits.take(3, "truncated code-length alphabet")
        spans[k] = (a, bits.where())
    code = Huffman(lengths, False)
    out.tables.append({"block": block, "kind": "code_length", "entries": _entries(code, spans), "build_order": len(out.tables)})
    found: list[int] = []
    where: list[tuple[int, int]] = []
    while len(found) < literals + distances:
        a = bits.where()
        s = code.read(bits, "code-length code")
        if s < 16:
            value, n = s, 1
        elif s == 16:
            if not found:
                raise _Stop("repeat code 16 has no previous length")
            value, n = found[-1], 3 + bits.take(2, "truncated code-length repeat")
        else:
            value, n = 0, 3 + bits.take(3, "truncated code-length repeat") if s == 17 else 11 + bits.take(7, "truncated code-length repeat")
        if len(found) + n > literals + distances:
            raise _Stop("code-length repeat exceeds the dynamic table")
        found += [value] * n
        where += [(a, bits.where())] * n
    if not found[256]:
        raise _Stop("dynamic literal/length table has no end-of-block code")
    pair = []
    for kind, part, spans_of in (("literal_length", found[:literals], where[:literals]), ("distance", found[literals:], where[literals:])):
        c = Huffman(part, True) if any(part) else None
        pair.append(c)
        out.tables.append({"block": block, "kind": kind, "entries": _entries(c, spans_of) if c else [], "build_order": len(out.tables)})
    return pair[0], pair[1]


def _symbols(bits: _Bits, out: Trace, origin: list[int], block: int, literal: Huffman, distance: Huffman | None, cap: int) -> None:
    data, tokens = out.data, out.tokens
    while True:
        a = bits.where()
        s = literal.read(bits, "huffman code")
        at = len(data)
        if s < 256:
            if at + 1 > cap:
                raise _Stop("output cap exceeded")
            data.append(s)
            origin.append(len(tokens))
            tokens.append(Token("literal", a, bits.where(), at, at + 1, literal=s, block=block))
        elif s == 256:
            tokens.append(Token("end_of_block", a, bits.where(), at, at, block=block))
            return
        else:
            if s > 285:
                raise _Stop("invalid literal/length symbol")
            base, extra = LENGTHS[s - 257]
            length = base + (bits.take(extra, "truncated length extra bits") if extra else 0)
            if distance is None:
                raise _Stop("distance table is empty")
            d = distance.read(bits, "distance code")
            if d > 29:
                raise _Stop("invalid distance code")
            base, extra = DISTANCES[d]
            back = base + (bits.take(extra, "truncated distance extra bits") if extra else 0)
            if back > at:
                raise _Stop("distance beyond available output")
            if at + length > cap:
                out.pending = back
                raise _Stop("output cap exceeded")
            sources: list[dict] = []
            for k in range(at - back, at - back + length):
                data.append(data[k])
                root = origin[k]
                origin.append(root)
                begin = tokens[root].output_begin
                if not (sources and sources[-1]["token_index"] == root):
                    sources.append({"begin": begin, "end": begin + 1, "token_index": root})
            tokens.append(Token("length_distance", a, bits.where(), at, at + length, length=length, distance=back, match_source_begin=at - back, match_source_end=at - back + length, sources=sources, block=block))


def _output(bits: _Bits, out: Trace, literal: Huffman, distance: Huffman | None, cap: int) -> None:
    """A block's output without its tokens."""
    data = out.data
    table, most, peek, end = literal.table, literal.most, bits.peek, bits.end
    while True:
        hit = table[peek(most)]
        if hit is None or bits.at + hit[1] > end:
            literal.read(bits, "huffman code")
        s = hit[0]
        bits.at += hit[1]
        if s < 256:
            if len(data) >= cap:
                raise _Stop("output cap exceeded")
            data.append(s)
            continue
        if s == 256:
            return
        if s > 285:
            raise _Stop("invalid literal/length symbol")
        base, extra = LENGTHS[s - 257]
        length = base + (bits.take(extra, "truncated length extra bits") if extra else 0)
        if distance is None:
            raise _Stop("distance table is empty")
        d = distance.read(bits, "distance code")
        if d > 29:
            raise _Stop("invalid distance code")
        base, extra = DISTANCES[d]
        back = base + (bits.take(extra, "truncated distance extra bits") if extra else 0)
        at = len(data)
        if back > at:
            raise _Stop("distance beyond available output")
        if at + length > cap:
            out.pending = back
            raise _Stop("output cap exceeded")
        part = data[at - back : at - back + length]
        while len(part) < length:
            part += part[: length - len(part)]
        data += part


def header_begin(stream: bytes) -> tuple[int, str]:
    """Where Deflate data begin, and what is wrong with the zlib header."""
    if len(stream) < 2:
        return 0, "stream too short for a zlib header"
    cmf, flg = stream[0], stream[1]
    if cmf & 15 != 8:
        return 0, "compression method is not deflate"
    if (cmf * 256 + flg) % 31:
        return 0, "zlib header check fails (FCHECK)"
    if cmf >> 4 > 7:
        return 0, "unsupported window size (CINFO)"
    if flg & 32:
        return 0, "preset dictionaries (FDICT) are not supported"
    if len(stream) < 6:
        return 2, "stream too short for the trailing Adler-32"
    return 2, ""


def trace(stream: bytes, cap: int, with_tokens: bool = True) -> Trace:
    """Tokens, blocks and tables of a zlib stream, up to ``cap`` bytes of output; without tokens it is faster."""
    out = Trace()
    if len(stream) > MAX_INPUT:
        out.error = "input too large for the trace decoder"
        return out
    out.deflate_data_begin, out.error = header_begin(stream)
    if out.error:
        return out
    bits = _Bits(stream, out.deflate_data_begin, len(stream) - 4)
    shift, origin, last = out.deflate_data_begin * 8, [], False
    try:
        while not last:
            begin, at, index = bits.where(), len(out.data), len(out.blocks)
            last = bool(bits.take(1, "truncated block header"))
            kind = bits.take(2, "truncated block header")
            if kind == 0:
                bits.at = (bits.at + 7) & ~7
                n, complement = bits.take(16, "truncated stored block header"), bits.take(16, "truncated stored block header")
                if n ^ complement != 0xFFFF:
                    raise _Stop("stored block LEN/NLEN mismatch")
                if not with_tokens:
                    if bits.left() < 8 * n:
                        raise _Stop("truncated stored block data")
                    if len(out.data) + n > cap:
                        raise _Stop("output cap exceeded")
                    out.data += stream[bits.at >> 3 : (bits.at >> 3) + n]
                    bits.at += 8 * n
                    n = 0
                for _ in range(n):
                    a = bits.where()
                    v = bits.take(8, "truncated stored block data")
                    if len(out.data) >= cap:
                        raise _Stop("output cap exceeded")
                    out.data.append(v)
                    origin.append(len(out.tokens))
                    out.tokens.append(Token("literal", a, a + 8, len(out.data) - 1, len(out.data), literal=v, block=index))
                if with_tokens:
                    out.tokens.append(Token("end_of_block", bits.where(), bits.where(), len(out.data), len(out.data), block=index))
            elif kind == 3:
                raise _Stop("reserved deflate block type")
            else:
                pair = fixed() if kind == 1 else _dynamic(bits, out, index)
                if with_tokens:
                    _symbols(bits, out, origin, index, *pair, cap)
                else:
                    _output(bits, out, *pair, cap)
            out.blocks.append({"idx": index, "type": ("stored", "fixed", "dynamic")[kind], "last": last, "input_bit_begin": begin + shift, "input_bit_end": bits.where() + shift, "output_begin": at, "output_end": len(out.data)})
        out.success = True
    except _Stop as e:
        out.error = str(e)
    return out


#: Bytes given to zlib at once.
STEP = 1 << 15


def _piece(stream: bytes, bit: int, end: int) -> bytes:
    """Up to STEP bytes from a bit on; the last byte is filled up with zeros."""
    raw = stream[bit >> 3 : min((bit >> 3) + STEP + 1, end)]
    return ((int.from_bytes(raw, "little") >> (bit & 7)).to_bytes(len(raw), "little") if bit & 7 else raw)[:STEP]


def block_output(stream: bytes, bit: int, end: int, history: bytes, most: int) -> tuple[bytes, int, bool] | None:
    """A block's output by zlib, the bit where it ends (-1: not looked for) and whether it is the last; None if it isn't sound.

    The block's copy is marked as the last, so that zlib stops behind it. Output of
    ``most`` bytes or more may be cut. Which bit of the last byte ends the block is
    known by turning its bits over, the highest first: one beyond the end changes nothing.
    """
    head = _piece(stream, bit, min(end, (bit >> 3) + 2))
    if not head:
        return None
    last, kind = bool(head[0] & 1), head[0] >> 1 & 3
    if kind == 0:
        at = (bit + 10) >> 3
        n = int.from_bytes(stream[at : at + 2], "little")
        if at + 4 + n > end or n ^ int.from_bytes(stream[at + 2 : at + 4], "little") != 0xFFFF:
            return None
        return stream[at + 4 : at + 4 + n], (at + 4 + n) * 8, last
    if kind == 3:
        return None
    d = zlib.decompressobj(-15, zdict=history)
    given, out, size, at = [], [], 0, bit
    try:
        while not d.eof:
            piece = _piece(stream, at, end)
            if not piece:
                return None
            given.append(piece if given else bytes([piece[0] | 1]) + piece[1:])
            out.append(d.decompress(given[-1], most - size))
            size += len(out[-1])
            at += 8 * len(piece)
            if size >= most:
                return b"".join(out), -1, last
        used = sum(map(len, given)) - len(d.unused_data)
        if last and not bit & 7:
            return b"".join(out), -1, True
        block = b"".join(given)[:used]
        d = zlib.decompressobj(-15, zdict=history)
        d.decompress(block[:-1])
        rest = d.copy().decompress(block[-1:])
    except zlib.error:
        return None
    stop = 8 * used - 7
    for k in range(7, 0, -1):
        c = d.copy()
        try:
            same = c.decompress(bytes([block[-1] ^ 1 << k])) == rest and c.eof
        except zlib.error:
            same = False
        if not same:
            stop += k
            break
    return (b"".join(out), bit + stop, last) if bit + stop <= 8 * end else None


def borders(stream: bytes, cap: int) -> tuple[list[tuple[int, int]], bytearray] | None:
    """(bit, output byte) where each block of a sound zlib stream begins, and its output; None where trace() must tell what is wrong."""
    if len(stream) > MAX_INPUT or header_begin(stream)[1]:
        return None
    bit, last, data, found = 16, False, bytearray(), []
    while not last:
        found.append((bit, len(data)))
        block = block_output(stream, bit, len(stream) - 4, bytes(data[-WINDOW:]), cap + 1 - len(data))
        if block is None or len(data) + len(block[0]) > cap:
            return None
        part, bit, last = block
        data += part
    return found, data
