"""Chunks, the virtual IDAT stream and the zlib wrapper."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from glyphlake.functions.perfile import per_file
from glyphlake.sources.files import u32

INDEX = "file_id bigint, path string, length bigint, content binary, signature_valid boolean, chunks array<struct<idx:bigint,type:binary,header_offset:bigint,data_offset:bigint,data_length:bigint,crc_offset:bigint>>, issues array<struct<kind:string,offset:bigint>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
KINDS = ("bad_signature", "truncated_signature", "truncated_header", "truncated_data", "truncated_crc", "trailing_bytes_after_iend")


def _spans(data: bytes, issues: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    """(header offset, data length, type) of each whole chunk; issues gets what is wrong."""
    size = len(data)
    if size < 8:
        issues.append({"kind": "truncated_signature", "offset": size})
        return
    if not data.startswith(_SIGNATURE):
        issues.append({"kind": "bad_signature", "offset": 0})
        return
    at, header = 8, struct.Struct(">I4s").unpack_from
    while at < size:
        if size - at < 8:
            issues.append({"kind": "truncated_header", "offset": at})
            break
        n, kind = header(data, at)
        if size - at - 8 < n:
            issues.append({"kind": "truncated_data", "offset": at + 8})
            break
        if size - at - 8 - n < 4:
            issues.append({"kind": "truncated_crc", "offset": at + 8 + n})
            break
        yield at, n, kind
        at += 12 + n
        if kind == b"IEND":
            if at < size:
                issues.append({"kind": "trailing_bytes_after_iend", "offset": at})
            break


def walk(data: bytes) -> tuple[bool, list[dict], list[dict]]:
    """Signature, whole chunks and issues; the walk ends at the first malformed chunk or after IEND."""
    issues: list[dict] = []
    chunks = [{"idx": k, "type": kind, "header_offset": at, "data_offset": at + 8, "data_length": n, "crc_offset": at + 8 + n} for k, (at, n, kind) in enumerate(_spans(data, issues))]
    return data.startswith(_SIGNATURE), chunks, issues


def index_files(files: DataFrame) -> DataFrame:
    """Files with their chunks and issues, one row a file."""

    def rows(file_id, path, length, content):
        yield (file_id, path, length, content, *walk(bytes(content or b"")))

    return per_file(files, INDEX, rows, "file_id", "path", "length", "content")


def type_text(kind: Column) -> Column:
    """A chunk's type, byte for character."""
    return F.decode(kind, "ISO-8859-1")


def chunks(indexed: DataFrame, *more: str) -> DataFrame:
    """One row a chunk, with the type as text; more: further columns of the file."""
    return indexed.select("file_id", *more, F.inline("chunks")).withColumn("type", type_text(F.col("type")))


def chunk_issues(indexed: DataFrame) -> DataFrame:
    return indexed.select("file_id", F.posexplode("issues").alias("seq", "i")).select("file_id", F.col("seq").cast("bigint").alias("seq"), "i.kind", "i.offset")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("computed", T.LongType()), T.StructField("stored", T.LongType())])))
def checksums(content: pa.Array, chunks: pa.Array) -> pa.Array:
    """CRC-32 over type and data of each chunk, and the one in the file; null where that can't be read. One walk over a file: a column's bytes are copied each time an expression reads them."""
    out = []
    for data, found in zip(content, chunks):
        view = memoryview(data.as_buffer() or b"")
        out.append([{"computed": zlib.crc32(view[c["header_offset"] + 4 : c["data_offset"] + c["data_length"]]), "stored": int.from_bytes(view[c["crc_offset"] : c["crc_offset"] + 4], "big")} if c["crc_offset"] + 4 <= len(view) else None for c in found.as_py() or ()])
    return pa.array(out, pa.list_(pa.struct([("computed", pa.int64()), ("stored", pa.int64())])))


@F.arrow_udf(T.BinaryType())
def idat_stream(content: pa.Array, chunks: pa.Array) -> pa.Array:
    """The IDAT data of each file as one, in time linear in its size."""
    flat = chunks.flatten()
    kinds = flat.field("type")
    idat = np.flatnonzero(pc.equal(kinds, pa.scalar(b"IDAT", kinds.type)).to_numpy(zero_copy_only=False))
    begins, sizes = (flat.field(c).to_numpy()[idat] for c in ("data_offset", "data_length"))
    ends = (begins + sizes).tolist()
    bounds = np.searchsorted(idat, np.cumsum([0, *chunks.value_lengths().fill_null(0).to_pylist()])).tolist()
    begins, out = begins.tolist(), []
    for data, first, end in zip(content, bounds, bounds[1:]):
        view = memoryview(data.as_buffer() or b"")
        out.append(b"".join([view[a:z] for a, z in zip(begins[first:end], ends[first:end])]))
    return pa.array(out, pa.binary())


def chunk_checksums(indexed: DataFrame) -> DataFrame:
    """(file_id, idx, type, computed, stored): CRC-32 over type and data, and the one in the file."""
    rows = indexed.select("file_id", F.inline(F.arrays_zip("chunks", checksums("content", "chunks").alias("crc"))))
    return rows.select("file_id", "chunks.idx", type_text(F.col("chunks.type")).alias("type"), "crc.computed", "crc.stored")


def idat_segments(indexed: DataFrame) -> DataFrame:
    """(file_id, seg, physical_offset, length, logical_start) of the IDAT chunks."""
    c = chunks(indexed).where("type = 'IDAT'")
    w = Window.partitionBy("file_id").orderBy("idx")
    start = F.coalesce(F.sum("data_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("file_id", (F.row_number().over(w) - 1).cast("bigint").alias("seg"), F.col("data_offset").alias("physical_offset"), F.col("data_length").alias("length"), start.alias("logical_start"))


def with_stream(indexed: DataFrame) -> DataFrame:
    """Files with ``stream``: the IDAT data as one, without a shuffle; empty where there is none."""
    return indexed.withColumn("stream", idat_stream("content", "chunks"))


def streams(files: DataFrame) -> DataFrame:
    """(file_id, stream) of files: with_stream() of their index, file by file and so in one pass with what makes and what reads them, if no chunk is asked for."""

    def rows(file_id, content):
        data = bytes(content or b"")
        yield file_id, b"".join([data[at + 8 : at + 8 + n] for at, n, kind in _spans(data, []) if kind == b"IDAT"])

    return per_file(files, "file_id bigint, stream binary", rows, "file_id", "content")


def logical_to_physical(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Physical pieces (file_id, request, seg, offset, length) of logical ranges (file_id, request, begin, length); none if a range leaves the stream."""
    size = segments.groupBy("file_id").agg(F.sum("length").alias("size"))
    inside = ranges.join(size, "file_id").where("begin >= 0 and begin + length <= size").select("file_id", "request", "begin", F.col("length").alias("want"))
    j = inside.join(segments, "file_id").where("want > 0 and logical_start < begin + want and begin < logical_start + length")
    first = F.greatest("begin", "logical_start")
    last = F.least(F.expr("begin + want"), F.expr("logical_start + length"))
    return j.select("file_id", "request", "seg", (F.col("physical_offset") + first - F.col("logical_start")).alias("offset"), (last - first).alias("length"))


def physical_to_logical(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Points (file_id, request, offset) with ``logical``: null in headers, checksums and other chunks."""
    s = segments.select(F.col("file_id").alias("f"), "physical_offset", "length", "logical_start")
    j = points.join(s, (F.col("file_id") == F.col("f")) & (F.col("offset") >= F.col("physical_offset")) & (F.col("offset") < F.col("physical_offset") + F.col("length")), "left")
    return j.select("file_id", "request", "offset", (F.col("logical_start") + F.col("offset") - F.col("physical_offset")).alias("logical"))


def ihdr(indexed: DataFrame, strict: bool = True) -> DataFrame:
    """Header fields of the first IHDR: of exactly 13 bytes if strict, else of 13 at least."""
    first = F.expr("get(filter(chunks, c -> c.type = X'49484452'), 0)")
    body = F.expr("substring(content, cast(h.data_offset + 1 as int), cast(h.data_length as int))")
    rows = indexed.select("file_id", first.alias("h"), "content").where("h is not null").select("file_id", "h", body.alias("b"))
    rows = rows.where("octet_length(b) = 13" if strict else "octet_length(b) >= 13")

    def byte(k: int) -> Column:
        return F.conv(F.hex(F.substring("b", k + 1, 1)), 16, 10).cast("int")

    return rows.select("file_id", u32(F.substring("b", 1, 4)).alias("width"), u32(F.substring("b", 5, 4)).alias("height"), *[byte(8 + i).alias(n) for i, n in enumerate(("bit_depth", "color_type", "compression", "filter", "interlace"))], F.col("h.header_offset").alias("header_offset"))


def wrapper(streams: DataFrame, *more: str) -> DataFrame:
    """The zlib wrapper of ``stream``: (file_id, success, error, deflate_data_begin, fields), and further columns; JVM only."""
    b = [F.conv(F.hex(F.substring("stream", k + 1, 1)), 16, 10).cast("bigint") for k in range(2)]
    s = streams.select("file_id", *more, "stream", F.octet_length("stream").cast("bigint").alias("n"), b[0].alias("cmf"), b[1].alias("flg"))
    s = s.selectExpr("*", "cmf & 15 as cm", "shiftright(cmf, 4) as cinfo", "(cmf * 256 + flg) % 31 = 0 as fcheck_ok", "(flg & 32) <> 0 as fdict", "shiftright(flg, 6) as flevel")
    s = s.selectExpr("*", "if(fdict, 6, 2) as cursor").selectExpr(
        "*",
        """case when n < 2 then 'stream too short for a zlib header'
                when cm <> 8 then 'compression method is not deflate'
                when not fcheck_ok then 'zlib header check fails (FCHECK)'
                when cinfo > 7 then 'unsupported window size (CINFO)'
                when fdict and n < 6 then 'FDICT set but DICTID is missing'
                when n < cursor + 4 then 'stream too short for the trailing Adler-32'
                else '' end as error""",
    )

    def field(name, value, text, offset, length, bit, aligned, when):
        return f"if({when}, named_struct('name', '{name}', 'value', cast({value} as bigint), 'text', {text}, 'offset', cast({offset} as bigint), 'length', cast({length} as bigint), 'bit_offset', {bit}, 'bit_aligned', {aligned}), null)"

    def word(at):
        return f"cast(conv(hex(substring(stream, cast({at} as int) + 1, 4)), 16, 10) as bigint)"

    head, dictid, adler = "n >= 2", "n >= 6 and fdict and cm = 8 and fcheck_ok and cinfo <= 7", "error = ''"
    fields = ", ".join([
        field("CM", "cm", "if(cm = 8, 'deflate', 'unknown')", "0", "4", "0", "true", head),
        field("CINFO", "cinfo", "concat('window 2^', cinfo + 8)", "0", "4", "4", "true", head),
        field("FCHECK", "flg & 31", "if(fcheck_ok, 'ok', 'bad')", "1", "5", "0", "true", head),
        field("FDICT", "if(fdict, 1, 0)", "if(fdict, 'set', 'unset')", "1", "1", "5", "true", head),
        field("FLEVEL", "flevel", "case flevel when 0 then 'fastest' when 3 then 'max' else 'default' end", "1", "2", "6", "true", head),
        field("DICTID", word("2"), f"concat('0x', lower(hex(substring(stream, 3, 4))))", "2", "4", "0", "false", dictid),
        field("ADLER32", word("n - 4"), "concat('0x', lower(hex(substring(stream, cast(n - 4 as int) + 1, 4))))", "n - 4", "4", "0", "false", adler),
    ])
    return s.selectExpr("file_id", *more, "error = '' as success", "error", "if(n >= 2 and cm = 8 and fcheck_ok and cinfo <= 7 and not (fdict and n < 6), cursor, 0) as deflate_data_begin", f"array_compact(array({fields})) as fields")


def wrapper_fields(wrapped: DataFrame) -> DataFrame:
    return wrapped.select("file_id", F.posexplode("fields").alias("seq", "f")).select("file_id", F.col("seq").cast("bigint").alias("seq"), "f.*")


def chunk_spans(indexed: DataFrame) -> DataFrame:
    """Selecting a chunk: its header (8 bytes), data and checksum (4 bytes) as physical spans."""
    spans = F.array(F.struct(F.lit("header").alias("part"), F.col("header_offset").alias("offset"), F.lit(8).cast("bigint").alias("length")), F.struct(F.lit("data").alias("part"), F.col("data_offset").alias("offset"), F.col("data_length").alias("length")), F.struct(F.lit("crc").alias("part"), F.col("crc_offset").alias("offset"), F.lit(4).cast("bigint").alias("length")))
    return chunks(indexed).select("file_id", "idx", "type", F.inline(spans))


def adler32(data: str) -> Column:
    """Adler-32 of a binary column, a batch at a time; null of null."""

    @F.arrow_udf(T.LongType())
    def checksum(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else zlib.adler32(v) for v in column.to_pylist()], pa.int64())

    return checksum(F.col(data))
