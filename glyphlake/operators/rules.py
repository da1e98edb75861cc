"""The 32 validation rules as expressions over one indexed file: no join, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.operators.structure import adler32, checksums

ISSUE = "struct<rule_id:string,severity:string,message:string,offset:bigint,spec_ref:string>"
_NONE = f"cast(array() as array<{ISSUE}>)"
# Limits on sides and on decoded bytes.
MAX_SIDE, MAX_DECODED = 1 << 28, 1 << 34
_IHDR, _IDAT, _IEND = "X'49484452'", "X'49444154'", "X'49454E44'"

# Messages and the section of the format's specification, by rule.
RULES = {
    "signature_invalid": ("file does not start with the PNG signature", "PNG:5.1"),
    "signature_truncated": ("file is shorter than the 8-byte PNG signature", "PNG:5.1"),
    "chunk_truncated": ("chunk envelope runs past the end of the file", "PNG:5.2"),
    "data_after_iend": ("bytes appear after the IEND chunk", "PNG:5.2"),
    "ihdr_required": ("first chunk is not IHDR", "PNG:5.2"),
    "ihdr_duplicate": ("more than one IHDR chunk", "PNG:5.2"),
    "iend_required": ("chunk stream does not end with IEND", "PNG:5.2"),
    "idat_not_contiguous": ("IDAT chunks are not consecutive", "PNG:5.2"),
    "chunk_integrity_unreadable": ("indexed chunk bytes are no longer readable", "PNG:5.2"),
    "chunk_crc_mismatch": ("chunk CRC does not match its type and data", "PNG:5.2"),
    "idat_adler_truncated": ("IDAT stream is too short for a zlib header and Adler-32", "PNG:13.2"),
    "idat_adler_input_too_large": ("inflated IDAT span exceeds the checksum API limit", "PNG:13.2"),
    "idat_adler_unreadable": ("IDAT Adler-32 trailer is not readable", "PNG:13.2"),
    "idat_adler_mismatch": ("IDAT Adler-32 does not match the inflated bytes", "PNG:13.2"),
    "ihdr_invalid_length": ("IHDR data length must be 13 bytes", "PNG:11.2.2"),
    "ihdr_unreadable": ("IHDR body is not readable", "PNG:11.2.2"),
    "ihdr_zero_dimension": ("IHDR width and height must be non-zero", "PNG:11.2.2"),
    "ihdr_bit_depth_color_type": ("IHDR bit depth is invalid for its color type", "PNG:11.2.2"),
    "ihdr_compression_method": ("IHDR compression method must be zero", "PNG:11.2.2"),
    "ihdr_filter_method": ("IHDR filter method must be zero", "PNG:11.2.2"),
    "ihdr_interlace_method": ("IHDR interlace method must be zero or one", "PNG:11.2.2"),
    "image_dimension_limit": ("image width or height exceeds the configured safety limit", "PNG:11.2.2"),
    "decoded_scanline_overflow": ("decoded scanline bit count overflows the safety arithmetic", "PNG:11.2.2"),
    "decoded_image_overflow": ("decoded image byte count overflows the safety arithmetic", "PNG:11.2.2"),
    "decoded_image_budget": ("decoded scanline storage exceeds the configured safety budget", "PNG:11.2.2"),
    "idat_required": ("PNG must contain an IDAT data stream", "PNG:11.2.4"),
    "idat_zlib_header_truncated": ("IDAT stream is shorter than the zlib header", "PNG:13.2"),
    "idat_zlib_header_unreadable": ("IDAT zlib header is not readable", "PNG:13.2"),
    "idat_zlib_method": ("IDAT zlib method must be Deflate", "PNG:13.2"),
    "idat_zlib_window": ("IDAT zlib window size is invalid", "PNG:13.2"),
    "idat_zlib_fcheck": ("IDAT zlib FCHECK is invalid", "PNG:13.2"),
    "idat_zlib_dictionary": ("PNG IDAT must not set FDICT", "PNG:13.2"),
}
NO_CHUNKS = "file contains no chunks and no IHDR"


def _issue(rule: str, offset: str, message: str | None = None) -> str:
    text, ref = RULES[rule]
    return f"named_struct('rule_id', '{rule}', 'severity', 'error', 'message', '{message or text}', 'offset', cast({offset} as bigint), 'spec_ref', '{ref}')"


def _if(when: str, rule: str, offset: str, message: str | None = None) -> str:
    return f"if({when}, array({_issue(rule, offset, message)}), {_NONE})"


def _facts(indexed: DataFrame) -> DataFrame:
    """What the rules look at, as columns that start with an underscore."""
    df = indexed.selectExpr(
        "*",
        f"filter(chunks, c -> c.type = {_IHDR}) as _ihdrs",
        f"filter(chunks, c -> c.type = {_IDAT}) as _idats",
    )
    df = df.selectExpr("*", "get(_ihdrs, 0) as _h", "coalesce(aggregate(_idats, 0L, (s, c) -> s + c.data_length), 0L) as _idat_size", "if(size(_idats) > 0, get(_idats, 0).data_offset, length) as _idat_at")
    df = df.selectExpr("*", "if(_h.data_length = 13 and _h.data_offset + 13 <= octet_length(content), substring(content, cast(_h.data_offset + 1 as int), 13), null) as _b")

    def number(first: int, n: int) -> str:
        return f"cast(conv(hex(substring(_b, {first + 1}, {n})), 16, 10) as bigint)"

    df = df.selectExpr("*", f"{number(0, 4)} as _w", f"{number(4, 4)} as _ht", *[f"{number(k, 1)} as _{n}" for k, n in ((8, "depth"), (9, "color"), (10, "comp"), (11, "filt"), (12, "lace"))])
    # The first two stream bytes may lie in two chunks: short prefixes of every chunk give them.
    head = "substring(aggregate(_idats, X'', (s, c) -> if(octet_length(s) >= 2, s, concat(s, substring(content, cast(c.data_offset + 1 as int), cast(least(c.data_length, 2L) as int))))), 1, 2)"
    df = df.selectExpr("*", f"{head} as _z")
    df = df.selectExpr("*", "cast(conv(hex(substring(_z, 1, 1)), 16, 10) as int) as _cmf", "cast(conv(hex(substring(_z, 2, 1)), 16, 10) as int) as _flg")
    channels = "case _color when 0 then 1 when 2 then 3 when 3 then 1 when 4 then 2 when 6 then 4 else 0 end"
    # Unsigned 64-bit arithmetic in decimals: an overflow is a finding, not an exception.
    return df.selectExpr("*", f"cast({channels} as decimal(20,0)) as _ch", "cast(18446744073709551615 as decimal(20,0)) as _most").selectExpr("*", "cast(_w as decimal(20,0)) * _ch * cast(_depth as decimal(20,0)) as _bits").selectExpr("*", "floor((_bits + 7) / 8) as _row")


def structure() -> str:
    kinds = f"transform(issues, i -> case i.kind when 'bad_signature' then {_issue('signature_invalid', 'i.offset')} when 'truncated_signature' then {_issue('signature_truncated', 'i.offset')} when 'trailing_bytes_after_iend' then {_issue('data_after_iend', 'i.offset')} else {_issue('chunk_truncated', 'i.offset')} end)"
    # An IDAT after the run ended: some chunk between it and the first IDAT is none.
    late = f"transform(filter(_idats, c -> exists(chunks, d -> d.type <> {_IDAT} and d.idx > get(_idats, 0).idx and d.idx < c.idx)), c -> {_issue('idat_not_contiguous', 'c.header_offset')})"
    rest = ", ".join([
        _if("size(chunks) = 0", "ihdr_required", "length", NO_CHUNKS),
        _if(f"size(chunks) > 0 and get(chunks, 0).type <> {_IHDR}", "ihdr_required", "get(chunks, 0).header_offset"),
        _if("size(_ihdrs) > 1", "ihdr_duplicate", "length"),
        _if(f"size(chunks) > 0 and not exists(chunks, c -> c.type = {_IEND})", "iend_required", "length"),
        late,
    ])
    return f"concat({kinds}, if(signature_valid, concat({rest}), {_NONE}))"


def integrity(inflated: str | None = None) -> str:
    """inflated: a binary column of the inflated stream, for the rules on its checksum."""
    bad = f"flatten(transform(arrays_zip(chunks, _crcs), z -> if(z._crcs is null, array({_issue('chunk_integrity_unreadable', 'z.chunks.header_offset')}), if(z._crcs.computed <> z._crcs.stored, array({_issue('chunk_crc_mismatch', 'z.chunks.crc_offset')}), {_NONE}))))"
    parts = [bad, _if("_idat_size > 0 and _idat_size < 6", "idat_adler_truncated", "_idat_at")]
    if inflated:
        large = f"octet_length({inflated}) > 4294967295"
        at = "_trailer_at"
        parts += [
            _if(f"_idat_size >= 6 and {inflated} is not null and {large}", "idat_adler_input_too_large", "_idat_at"),
            _if(f"_idat_size >= 6 and {inflated} is not null and not {large} and octet_length(_trailer) < 4", "idat_adler_unreadable", at),
            _if(f"_idat_size >= 6 and {inflated} is not null and not {large} and octet_length(_trailer) = 4 and cast(_adler as string) <> conv(hex(_trailer), 16, 10)", "idat_adler_mismatch", at),
        ]
    return f"concat({', '.join(parts)})"


def semantics() -> str:
    legal = "(_color = 0 and _depth in (1, 2, 4, 8, 16)) or (_color = 3 and _depth in (1, 2, 4, 8)) or (_color in (2, 4, 6) and _depth in (8, 16))"
    at = "_h.data_offset"
    rest = ", ".join([
        _if("_w = 0 or _ht = 0", "ihdr_zero_dimension", at),
        _if(f"not ({legal})", "ihdr_bit_depth_color_type", f"{at} + 8"),
        _if("_comp <> 0", "ihdr_compression_method", f"{at} + 10"),
        _if("_filt <> 0", "ihdr_filter_method", f"{at} + 11"),
        _if("_lace > 1", "ihdr_interlace_method", f"{at} + 12"),
    ])
    return f"case when _h is null then {_NONE} when _h.data_length <> 13 then array({_issue('ihdr_invalid_length', '_h.header_offset')}) when _b is null then array({_issue('ihdr_unreadable', at)}) else concat({rest}) end"


def resources() -> str:
    at = "_h.header_offset"
    return f"""case when _b is null then {_NONE}
      when _w > {MAX_SIDE} or _ht > {MAX_SIDE} then array({_issue('image_dimension_limit', at)})
      when _ch = 0 then {_NONE}
      when _bits > _most - 7 then array({_issue('decoded_scanline_overflow', at)})
      when _row * _ht > _most then array({_issue('decoded_image_overflow', at)})
      when _row * _ht > {MAX_DECODED} then array({_issue('decoded_image_budget', at)})
      else {_NONE} end"""


def decode() -> str:
    rest = ", ".join([
        _if("_cmf % 16 <> 8", "idat_zlib_method", "_idat_at"),
        _if("shiftright(_cmf, 4) > 7", "idat_zlib_window", "_idat_at"),
        _if("(_cmf * 256 + _flg) % 31 <> 0", "idat_zlib_fcheck", "_idat_at + 1"),
        _if("(_flg & 32) <> 0", "idat_zlib_dictionary", "_idat_at + 1"),
    ])
    return f"case when _idat_size = 0 then array({_issue('idat_required', '_idat_at')}) when _idat_size < 2 then array({_issue('idat_zlib_header_truncated', '_idat_at')}) when octet_length(_z) < 2 then array({_issue('idat_zlib_header_unreadable', '_idat_at')}) else concat({rest}) end"


def validate(indexed: DataFrame, inflated: str | None = None, families: str = "structure integrity semantics resources decode") -> DataFrame:
    """Indexed files with ``report``: the issues of the families, in order."""
    df = _facts(indexed)
    if inflated:
        last = "(aggregate(_idats, X'', (s, c) -> substring(concat(s, substring(content, cast(c.data_offset + greatest(c.data_length - 4, 0L) + 1 as int), cast(least(c.data_length, 4L) as int))), -4)))"
        df = df.withColumn("_trailer", F.expr(last)).withColumn("_adler", adler32(inflated))
        # Where the trailer starts: bytes of the stream that follow each chunk tell.
        after = "aggregate(filter(_idats, d -> d.idx > c.idx), 0L, (s, d) -> s + d.data_length)"
        df = df.withColumn("_trailer_at", F.expr(f"get(transform(filter(_idats, c -> {after} < 4 and c.data_length + {after} >= 4), c -> c.data_offset + c.data_length + {after} - 4), 0)"))
    if "integrity" in families.split():
        df = df.withColumn("_crcs", checksums("content", "chunks"))
    parts = {"structure": structure, "integrity": lambda: integrity(inflated), "semantics": semantics, "resources": resources, "decode": decode}
    report = f"concat({', '.join(parts[f]() for f in families.split())})"
    return df.withColumn("report", F.expr(report)).select(*indexed.columns, "report")


def validation_issues(validated: DataFrame) -> DataFrame:
    return validated.select("file_id", F.posexplode("report").alias("seq", "i")).select("file_id", F.col("seq").cast("bigint").alias("seq"), "i.*")


def exit_code(issues: str = "issues", report: str = "report") -> Column:
    """0 in order, 2 a format error, 3 other issues; a format error wins."""
    return F.expr(f"case when exists({issues}, i -> i.kind <> 'trailing_bytes_after_iend') then 2 when size({issues}) > 0 or size({report}) > 0 then 3 else 0 end")
