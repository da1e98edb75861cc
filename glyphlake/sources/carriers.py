"""Tables carried as PNG files, so that an operator's result has a closed form over the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from glyphlake.functions.perfile import per_file
from glyphlake.sources import encode as E

FILES = "file_id bigint, path string, length bigint, content binary"
WIDTH, SPLIT = 16, 100
EVENT_TYPES = 8


def _row(file_id: int, kind: str, content: bytes) -> tuple:
    return file_id, f"{kind}/{file_id}.png", len(content), content


#: Pieces of a table for each core, where the session leaves it to Spark, and where Spark would make about one: a task more than there are cores doubles the time.
PIECES, PIECES_KEY = 4, "spark.sql.files.minPartitionNum"


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out over them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if not spark.conf.get(PIECES_KEY, None):
        spark.conf.set(PIECES_KEY, str(PIECES * cores))
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def gray_texts(spark, sf_dir: str, table: str = "documents", key: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """Whole texts as 16 columns of 8-bit gray: five filters in turn and zlib, or no filter and stored blocks; IDAT split."""

    def rows(k, t):
        height, s = E.gray_bytes((t or "").encode(), WIDTH)
        raw = E.filtered_stream(s, 8, 0, rotating=not stored)
        stream = E.stored_stream(raw) if stored else E.zlib_stream(raw)
        yield _row(k, "stored" if stored else "gray", E.png(E.ihdr(WIDTH, height, 8, 0), stream, SPLIT if not stored else 10 * SPLIT))

    return per_file(_read(spark, sf_dir, table), FILES, rows, key, text)


def literal_texts(spark, sf_dir: str) -> DataFrame:
    """Benchmark texts as one row of gray pixels, in a fixed-Huffman block of literals."""

    def rows(k, t):
        data = (t or "").encode() or b"\0"
        yield _row(k, "literal", E.png(E.ihdr(len(data), 1, 8, 0), E.literal_stream(b"\0" + data), SPLIT))

    return per_file(_read(spark, sf_dir, "benchmark"), FILES, rows, "item_id", "text")


def order_lines(spark, sf_dir: str) -> DataFrame:
    """An order as one row of 16-bit RGB: quantity, discount and tax in hundredths, a pixel a line."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("t")))).alias("lines"))

    def rows(k, items):
        s = np.array([[[i["q"], i["d"], i["t"]] for i in items]])
        yield _row(k, "order", E.png(E.ihdr(len(items), 1, 16, 2), E.zlib_stream(E.filtered_stream(s, 16, 2))))

    return per_file(lines, FILES, rows, "l_orderkey", "lines")


def event_blocks(spark, sf_dir: str) -> DataFrame:
    """64 events in order of event_id as 8 by 8 interlaced palette pixels of four bits: the length of the event's type modulo 16."""
    e = _read(spark, sf_dir, "events").select((F.col("event_id") / 64).cast("bigint").alias("k"), (F.col("event_id") % 64).cast("int").alias("i"), (F.length("event_type") % 16).alias("v"))

    def rows(k, items):
        s = np.zeros(64, np.int64)
        for i in items:
            s[i["i"]] = i["v"]
        stream = E.zlib_stream(E.filtered_stream(s.reshape(8, 8, 1), 4, 3, True))
        yield _row(k, "event", E.png(E.ihdr(8, 8, 4, 3, 1), stream, palette=E.palette_of(4)))

    return per_file(e.groupBy("k").agg(F.collect_list(F.struct("i", "v")).alias("items")), FILES, rows, "k", "items")


def label_runs(spark, sf_dir: str) -> DataFrame:
    """(file_id, stream): the label's quality as 300 equal bytes in a fixed-Huffman zlib stream."""
    import zlib

    def rows(k, q):
        yield k, E.zlib_stream(bytes([q or 0]) * 300, 9, zlib.Z_FIXED)

    return per_file(_read(spark, sf_dir, "labels"), "file_id bigint, stream binary", rows, "doc_id", "quality")


#: Faults of broken(), by customer key modulo their number.
FAULTS = ("none", "signature_invalid", "signature_truncated", "chunk_truncated", "data_after_iend", "ihdr_required", "ihdr_duplicate", "iend_required", "idat_not_contiguous", "chunk_crc_mismatch", "idat_adler_truncated", "ihdr_invalid_length", "ihdr_zero_dimension", "ihdr_bit_depth_color_type", "ihdr_compression_method", "ihdr_filter_method", "ihdr_interlace_method", "image_dimension_limit", "decoded_image_budget", "idat_required", "idat_zlib_header_truncated", "idat_zlib_method", "idat_zlib_window", "idat_zlib_fcheck", "idat_zlib_dictionary", "decoded_image_overflow")


def broken_file(fault: str, name: bytes) -> bytes:
    """One row of gray pixels with a single fault."""
    raw = b"\0" + name
    head, stream = bytearray(E.ihdr(len(name), 1, 8, 0)), bytearray(E.stored_stream(raw))
    first, last = E.chunk(b"IHDR", bytes(head)), E.chunk(b"IEND", b"")
    data = E.chunk(b"IDAT", bytes(stream))
    fields = {"ihdr_zero_dimension": (0, 0), "ihdr_bit_depth_color_type": (8, 3), "ihdr_compression_method": (10, 1), "ihdr_filter_method": (11, 1), "ihdr_interlace_method": (12, 2)}
    if fault in fields:
        at, v = fields[fault]
        head[at : at + (4 if at == 0 else 1)] = bytes(4) if at == 0 else bytes([v])
        first = E.chunk(b"IHDR", bytes(head))
    elif fault == "image_dimension_limit":
        first = E.chunk(b"IHDR", E.ihdr((1 << 28) + 1, 1, 8, 0))
    elif fault in ("decoded_image_budget", "decoded_image_overflow"):
        first = E.chunk(b"IHDR", E.ihdr(1 << 28, 1 << 28, 16, 6))
    elif fault == "ihdr_invalid_length":
        first = E.chunk(b"IHDR", bytes(head) + b"\0")
    elif fault == "ihdr_required":
        first = b""
    elif fault == "ihdr_duplicate":
        first += first
    elif fault == "iend_required":
        last = b""
    elif fault == "idat_not_contiguous":
        data = E.chunk(b"IDAT", bytes(stream[:4])) + E.chunk(b"tEXt", b"k\0v") + E.chunk(b"IDAT", bytes(stream[4:]))
    elif fault == "chunk_crc_mismatch":
        data = data[:-1] + bytes([data[-1] ^ 1])
    elif fault == "idat_adler_truncated":
        data = E.chunk(b"IDAT", bytes(stream[:5]))
    elif fault == "idat_required":
        data = b""
    elif fault == "idat_zlib_header_truncated":
        data = E.chunk(b"IDAT", bytes(stream[:1]))
    elif fault.startswith("idat_zlib"):
        pair = {"idat_zlib_method": (0x77, 0x09), "idat_zlib_window": (0x88, 0x1C), "idat_zlib_fcheck": (0x78, 0x02), "idat_zlib_dictionary": (0x78, 0x20)}[fault]
        data = E.chunk(b"IDAT", bytes(pair) + bytes(stream[2:]))
    out = E.SIGNATURE + first + data + last
    if fault == "signature_invalid":
        out = b"\x88" + out[1:]
    elif fault == "signature_truncated":
        out = out[:5]
    elif fault == "chunk_truncated":
        out = out[:-6]
    elif fault == "data_after_iend":
        out += b"xyz"
    return out


def broken(spark, sf_dir: str) -> DataFrame:
    """Customer names with one fault each."""

    def rows(k, name):
        yield _row(k, "broken", broken_file(FAULTS[k % len(FAULTS)], (name or "").encode() or b"\0"))

    return per_file(_read(spark, sf_dir, "customer"), FILES, rows, "c_custkey", "c_name")
