"""Stages of an image: inflated bytes, scanlines, filter steps, samples, delivered pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphlake.functions import raster
from glyphlake.functions.perfile import per_file
from glyphlake.operators.structure import with_stream

_INPUT = ("file_id", "signature_valid", "stream", "head")


def decode_input(indexed: DataFrame) -> DataFrame:
    """(file_id, signature_valid, stream, head, palette, transparency): what decoding needs; head is null unless IHDR has 13 bytes at least."""
    def first(kind: str) -> str:
        return f"get(transform(filter(chunks, c -> c.type = X'{kind}'), c -> substring(content, cast(c.data_offset + 1 as int), cast(c.data_length as int))), 0)"

    return with_stream(indexed).selectExpr("file_id", "signature_valid", "stream", f"if(octet_length({first('49484452')}) >= 13, substring({first('49484452')}, 1, 13), null) as head", f"{first('504C5445')} as palette", f"{first('74524E53')} as transparency")


def _unreadable(valid, head) -> str:
    return "invalid PNG signature" if not valid else "missing or invalid IHDR" if head is None else ""


def _sizes(head) -> tuple:
    return int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12] == 1


def _analyzed(valid, stream, head, plain: bool = True) -> raster.Stages:
    if error := _unreadable(valid, head):
        return raster.Stages(error=error)
    return raster.analyze(bytes(stream), *_sizes(head), plain)


def inflated(indexed: DataFrame) -> DataFrame:
    """(file_id, success, error, filtered, stream): stages() as far as the inflated bytes, beside what was decoded."""

    def rows(file_id, valid, stream, head):
        data, error = b"", _unreadable(valid, head)
        if not error:
            _, data, error = raster.filtered(bytes(stream), *_sizes(head))
        yield file_id, not error, error, None if error else data, stream

    return per_file(decode_input(indexed), "file_id bigint, success boolean, error string, filtered binary, stream binary", rows, *_INPUT)


def stages(indexed: DataFrame, *more: str) -> DataFrame:
    """One row a file: success, error, and the bytes of every stage; more: ``stream``, to have what was decoded beside it."""

    def rows(file_id, valid, stream, head):
        s = _analyzed(valid, stream, head)
        out = (file_id, s.success, s.error, s.filtered if s.success else None, s.unfiltered if s.success else None, len(s.scanlines))
        yield (*out, stream) if more else out

    return per_file(decode_input(indexed), "file_id bigint, success boolean, error string, filtered binary, unfiltered binary, scanlines bigint" + ", stream binary" * bool(more), rows, *_INPUT)


_SCANLINE = {"stream_row": "bigint", "pass": "int", "row_in_pass": "bigint", "offset": "bigint", "length": "bigint", "filter_type": "int", "filtered": "binary", "unfiltered": "binary"}


def scanlines(indexed: DataFrame, *columns: str) -> DataFrame:
    """file_id and the columns of every scanline (default: all); filters are undone only where the result is asked for."""
    columns = columns or tuple(_SCANLINE)

    def rows(file_id, valid, stream, head):
        s = _analyzed(valid, stream, head, "unfiltered" in columns)
        for r in s.scanlines if s.success else ():
            yield (file_id, *[r[c] for c in columns])

    return per_file(decode_input(indexed), "file_id bigint, " + ", ".join(f"{c} {_SCANLINE[c]}" for c in columns), rows, *_INPUT)


def filter_events(indexed: DataFrame, row: int | None = None) -> DataFrame:
    """One step a byte of every scanline, or of one."""

    def rows(file_id, valid, stream, head):
        s = _analyzed(valid, stream, head)
        for r in s.scanlines if s.success else ():
            if row is None or r["stream_row"] == row:
                for e in raster.events(r["filter_type"], r["filtered"], r["unfiltered"], r["above"], raster.bytes_per_pixel(head[8], head[9])):
                    yield file_id, r["stream_row"], e["idx"], r["filter_type"], e["raw"], e["a"], e["b"], e["c"], e["predictor"], e["recon"]

    return per_file(decode_input(indexed), "file_id bigint, stream_row bigint, idx bigint, type int, raw int, a int, b int, c int, predictor int, recon int", rows, *_INPUT)


def pixels(indexed: DataFrame) -> DataFrame:
    """(file_id, y, x, samples): native samples of every pixel; a palette's stay indices."""

    def rows(file_id, valid, stream, head):
        s = _analyzed(valid, stream, head)
        if s.success:
            for y, line in enumerate(s.samples.tolist()):
                for x, v in enumerate(line):
                    yield file_id, y, x, v

    return per_file(decode_input(indexed), "file_id bigint, y bigint, x bigint, samples array<int>", rows, *_INPUT)


def samples(indexed: DataFrame) -> DataFrame:
    """(file_id, y, x, channel, value)."""
    return pixels(indexed).select("file_id", "y", "x", F.posexplode("samples").alias("channel", "value"))


def delivered(indexed: DataFrame) -> DataFrame:
    """(file_id, y, x, r, g, b, a): eight bits a channel, opaque where the file says nothing else; expressions only above the samples."""
    p = pixels(indexed).join(decode_input(indexed).select("file_id", "head", "palette", "transparency"), "file_id")
    p = p.selectExpr("file_id", "y", "x", "samples", "cast(conv(hex(substring(head, 9, 1)), 16, 10) as int) as depth", "cast(conv(hex(substring(head, 10, 1)), 16, 10) as int) as color", "palette", "transparency")

    def eight(k: int) -> str:
        v = f"get(samples, {k})"
        return f"case depth when 16 then shiftright({v}, 8) when 8 then {v} when 4 then {v} * 17 when 2 then {v} * 85 else {v} * 255 end"

    def entry(k: int) -> str:
        return f"cast(conv(hex(substring(palette, get(samples, 0) * 3 + {k + 1}, 1)), 16, 10) as int)"

    def word(k: int) -> str:
        return f"cast(conv(hex(substring(transparency, {2 * k + 1}, 2)), 16, 10) as int)"

    clear = f"case when transparency is null then false when color = 0 then get(samples, 0) = {word(0)} when color = 2 then get(samples, 0) = {word(0)} and get(samples, 1) = {word(1)} and get(samples, 2) = {word(2)} else false end"
    alpha = f"case when color = 3 then if(octet_length(transparency) > get(samples, 0), cast(conv(hex(substring(transparency, get(samples, 0) + 1, 1)), 16, 10) as int), 255) when color = 4 then {eight(1)} when color = 6 then {eight(3)} when {clear} then 0 else 255 end"
    rgb = [f"case when color = 3 then {entry(k)} when color in (0, 4) then {eight(0)} else {eight(k)} end as {n}" for k, n in enumerate("rgb")]
    return p.selectExpr("file_id", "y", "x", *rgb, f"{alpha} as a")


def image_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """First differing sample (y, x, channel, values) of files that both sides hold, in row-major order."""
    j = left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), ["file_id", "y", "x", "channel"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    return j.groupBy("file_id").agg(F.min(F.struct("y", "x", "channel", "left_value", "right_value")).alias("d"), F.count("*").alias("differing")).select("file_id", "d.*", "differing")
