"""Deflate as tables: blocks, tokens, Huffman entries, access points."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from glyphlake.functions import deflate
from glyphlake.functions.perfile import per_file

#: Output bytes that a trace may have, unless a caller says otherwise.
MAX_OUTPUT = 1 << 30
TOKEN = "idx bigint, kind string, input_bit_begin bigint, input_bit_end bigint, output_begin bigint, output_end bigint, literal int, length int, distance int, match_source_begin bigint, match_source_end bigint, sources array<struct<begin:bigint,end:bigint,token_index:bigint>>, block_idx bigint, stream_bit_begin bigint, stream_bit_end bigint"
POINTS = "file_id bigint, idx bigint, input_byte bigint, prime_bits int, prime_value int, output_offset bigint, dictionary binary, zlib_header binary, total_output bigint"


def traces(streams: DataFrame, max_output: int = MAX_OUTPUT) -> DataFrame:
    """(file_id, success, error, output_bytes, deflate_data_begin) of every (file_id, stream)."""

    def rows(file_id, stream):
        t = deflate.trace(bytes(stream or b""), max_output)
        yield file_id, t.success, t.error, len(t.data), t.deflate_data_begin, len(t.tokens), len(t.blocks)

    return per_file(streams, "file_id bigint, success boolean, error string, output_bytes bigint, deflate_data_begin bigint, tokens bigint, blocks bigint", rows, "file_id", "stream")


def tokens(streams: DataFrame, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Tokens; input bits count from the data's beginning, stream bits from the zlib header."""

    def rows(file_id, stream):
        t = deflate.trace(bytes(stream or b""), max_output)
        shift = t.deflate_data_begin * 8
        for i, k in enumerate(t.tokens):
            yield file_id, i, k.kind, k.input_bit_begin, k.input_bit_end, k.output_begin, k.output_end, k.literal, k.length, k.distance, k.match_source_begin, k.match_source_end, k.sources, k.block, k.input_bit_begin + shift, k.input_bit_end + shift

    return per_file(streams, f"file_id bigint, {TOKEN}", rows, "file_id", "stream")


def blocks(streams: DataFrame, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Blocks; bits count from the zlib header."""

    def rows(file_id, stream):
        for b in deflate.trace(bytes(stream or b""), max_output, False).blocks:
            yield file_id, b["idx"], b["type"], b["last"], b["input_bit_begin"], b["input_bit_end"], b["output_begin"], b["output_end"]

    return per_file(streams, "file_id bigint, idx bigint, type string, last boolean, input_bit_begin bigint, input_bit_end bigint, output_begin bigint, output_end bigint", rows, "file_id", "stream")


def huffman_entries(streams: DataFrame, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Entries of the dynamic tables, with the bits that declared each."""

    def rows(file_id, stream):
        for k, t in enumerate(deflate.trace(bytes(stream or b""), max_output, False).tables):
            for e in t["entries"]:
                yield file_id, k, t["block"], t["kind"], e["symbol"], e["bit_length"], e["canonical_code"], e["prov_begin"], e["prov_end"]

    return per_file(streams, "file_id bigint, table_idx bigint, block_idx bigint, kind string, symbol int, bit_length int, canonical_code int, prov_begin bigint, prov_end bigint", rows, "file_id", "stream")


def block_for_output(block_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Points (file_id, request, offset) with the block that holds that output byte, if one does."""
    b = block_rows.select("file_id", F.col("idx").alias("block_idx"), "output_begin", "output_end")
    hit = points.join(b, "file_id").where("offset >= output_begin and offset < output_end").groupBy("file_id", "request").agg(F.min("block_idx").alias("block_idx"))
    return points.join(hit, ["file_id", "request"], "left")


def containing(token_rows: DataFrame, points: DataFrame) -> DataFrame:
    """The token that holds each output byte of points (file_id, request, offset): a join by bucket of output, then by range."""
    return _overlap(token_rows, points.withColumns({"begin": F.col("offset"), "end": F.col("offset") + 1})).select("file_id", "request", "offset", F.col("idx").alias("token_index"), "output_begin", "output_end")


#: Output bytes of a bucket of the range joins.
BUCKET = 1024


def _overlap(token_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    t = token_rows.where("output_end > output_begin").withColumn("bucket", F.explode(F.expr(f"sequence(output_begin div {BUCKET}, (output_end - 1) div {BUCKET})")))
    r = ranges.where("end > begin").withColumn("bucket", F.explode(F.expr(f"sequence(begin div {BUCKET}, (end - 1) div {BUCKET})")))
    # A pair that shares several buckets counts in the first of them.
    first = F.expr(f"greatest(begin div {BUCKET}, output_begin div {BUCKET})")
    return r.join(t, ["file_id", "bucket"]).where("output_begin < end and begin < output_end").where(F.col("bucket") == first).drop("bucket")


def overlapping(token_rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Tokens that overlap output ranges (file_id, request, begin, end)."""
    return _overlap(token_rows, ranges).select("file_id", "request", F.col("idx").alias("token_index"), "output_begin", "output_end")


def _points(stream: bytes, min_interval: int, max_output: int) -> list[tuple]:
    """Access points of a sound stream; zlib finds the blocks, the decoder those of streams it refuses."""
    if found := deflate.borders(stream, max_output):
        begins, data = found
    else:
        t = deflate.trace(stream, max_output, False)
        begins, data = [(b["input_bit_begin"], b["output_begin"]) for b in t.blocks if t.success], t.data
    out, last = [], None
    for begin, at in begins:
        if last is None or at - last >= min_interval:
            byte, bit = divmod(begin, 8)
            prime = (8 - bit) % 8
            out.append((len(out), byte + (bit > 0), prime, stream[byte] >> bit if prime else 0, at, bytes(data[max(0, at - deflate.WINDOW) : at]), stream[:2], len(data)))
            last = at
    return out


def access_points(streams: DataFrame, min_interval: int, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Points to resume from: the first at 0, then block boundaries min_interval output bytes apart at least.

    A boundary inside a byte primes the byte's remaining high bits and goes on with the next byte.
    """

    def rows(file_id, stream):
        for p in _points(bytes(stream or b""), min_interval, max_output):
            yield file_id, *p

    return per_file(streams, POINTS, rows, "file_id", "stream")


_POINT = ("input_byte", "prime_bits", "prime_value", "output_offset", "dictionary", "zlib_header", "total_output")


def _refused(offset, length, point, stream) -> str:
    if point is None or offset is None or length is None:
        return "no access index"
    if offset < 0 or length < 0 or offset + length > point["total_output"]:
        return "output range out of bounds"
    if stream is None or len(stream) < 2:
        return "source too short for the indexed stream"
    if stream[:2] != point["zlib_header"]:
        return "source changed since indexing"
    if point["input_byte"] >= len(stream):
        return "source too short for the access point"
    bits = point["prime_bits"]
    return "source changed at the access point" if bits and stream[point["input_byte"] - 1] >> (8 - bits) != point["prime_value"] else ""


def _extracted(offset, length, point, stream) -> tuple:
    """(success, error, data) of an output range, resumed from a point."""
    from glyphlake.functions.replay import replay

    if error := _refused(offset, length, point, stream):
        return False, error, None
    data, error = replay(bytes(stream), point["input_byte"] * 8 - point["prime_bits"], bytes(point["dictionary"]), offset - point["output_offset"] + length)
    data = data[offset - point["output_offset"] :]
    if error or len(data) != length:
        return False, error or "requested output not fully produced", None
    return True, "", data


_EXTRACTED = "file_id bigint, request bigint, success boolean, error string, data binary"


def extract_output(points: DataFrame, streams: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, request, success, error, data) for output ranges (file_id, request, offset, length): resumed from the nearest point at or before.

    A range must lie within the output that was indexed; a stream whose zlib header or
    primed bits aren't those of the index isn't the one that was indexed.
    """
    near = ranges.join(points, "file_id").where("output_offset <= greatest(offset, 0)").groupBy("file_id", "request", "offset", "length").agg(F.max_by(F.struct(*_POINT), "output_offset").alias("p"))
    found = ranges.join(near, ["file_id", "request", "offset", "length"], "left").join(streams, "file_id", "left")

    def rows(file_id, request, offset, length, point, stream):
        yield file_id, request, *_extracted(offset, length, point, stream)

    return per_file(found, _EXTRACTED, rows, "file_id", "request", "offset", "length", "p", "stream")


def index_and_extract(files: DataFrame, min_interval: int, max_output: int = MAX_OUTPUT, kept: str | None = None, ask: Callable[[bytes], Iterable[dict]] | None = None) -> DataFrame:
    """extract_output() from the points of access_points(), without a join: files (file_id, stream, requests) have what is asked of them beside what is indexed.

    requests: array<struct<request, offset, length, source>>, source being the stream that is read; kept: a binary column that every row gets.
    ask: gives a stream's requests in place of that column, so that files straight from another step need no pass of their own.
    """

    def rows(file_id, stream, *more):
        stream = bytes(stream or b"")
        requests, *more = (ask(stream), *more) if ask else more
        points = [dict(zip(_POINT, p[1:])) for p in _points(stream, min_interval, max_output)]
        for r in requests or ():
            near = None
            if r["offset"] is not None:
                near = max((p for p in points if p["output_offset"] <= max(r["offset"], 0)), key=lambda p: p["output_offset"], default=None)
            yield file_id, r["request"], *_extracted(r["offset"], r["length"], near, r["source"]), *more

    more = (kept,) if kept else ()
    return per_file(files, _EXTRACTED + "".join(f", {c} binary" for c in more), rows, "file_id", "stream", *(() if ask else ("requests",)), *more)
