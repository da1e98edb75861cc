"""Reports as JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.operators.structure import type_text


def json_text(c: Column) -> Column:
    """A JSON string: quotes, backslashes and every control character escaped."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _object(**fields: Column) -> Column:
    parts = []
    for k, v in fields.items():
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), v]
    return F.concat(*parts, F.lit("}"))


def _number(c: Column) -> Column:
    return c.cast("string")


def inspect_json(indexed: DataFrame) -> DataFrame:
    """(file_id, json): file, size, signature_valid, chunks and issues, in fixed order of keys."""
    chunks = F.transform("chunks", lambda c: _object(type=json_text(type_text(c["type"])), header_offset=_number(c["header_offset"]), data_offset=_number(c["data_offset"]), data_length=_number(c["data_length"]), crc_offset=_number(c["crc_offset"])))
    issues = F.transform("issues", lambda i: _object(kind=json_text(i["kind"]), offset=_number(i["offset"])))
    return indexed.select("file_id", _object(file=json_text(F.col("path")), size=_number(F.col("length")), signature_valid=_number(F.col("signature_valid")), chunks=_list(chunks), issues=_list(issues)).alias("json"))


def validate_json(validated: DataFrame) -> DataFrame:
    """(file_id, json): file, size, valid and issues."""
    issues = F.transform("report", lambda i: _object(rule_id=json_text(i["rule_id"]), severity=json_text(i["severity"]), message=json_text(i["message"]), offset=_number(i["offset"]), spec_ref=json_text(i["spec_ref"])))
    return validated.select("file_id", _object(file=json_text(F.col("path")), size=_number(F.col("length")), valid=_number(F.size("report") == 0), issues=_list(issues)).alias("json"))


def error_json(missing: DataFrame, code: int) -> DataFrame:
    """(path, json) for paths that can't be read."""
    return missing.select("path", _object(file=json_text(F.col("path")), error=F.lit("true"), error_code=F.lit(str(code))).alias("json"))


def chunk_tree(indexed: DataFrame) -> DataFrame:
    """(file_id, text): the tree of chunks for people."""
    head = F.format_string("file: %s (%d bytes) signature=%s", "path", "length", F.when(F.col("signature_valid"), "valid").otherwise("invalid"))
    lines = F.transform("chunks", lambda c: F.concat(F.lit("  "), type_text(c["type"]), F.lit(" data="), _number(c["data_length"]), F.lit("@"), _number(c["data_offset"]), F.lit(" crc@"), _number(c["crc_offset"])))
    issues = F.transform("issues", lambda i: F.concat(F.lit("  issue: "), i["kind"], F.lit(" @ "), _number(i["offset"])))
    return indexed.select("file_id", F.array_join(F.concat(F.array(head), lines, issues), "\n").alias("text"))


def percent_escaped(c: Column) -> Column:
    """Every byte but letters, digits, '.', '_' and '-' as % and two hexadecimal digits."""
    h = F.hex(F.encode(c, "UTF-8"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.length(h) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))
    safe = F.transform(pairs, lambda p: F.when(F.decode(F.unhex(p), "ISO-8859-1").rlike("^[A-Za-z0-9._-]$"), F.decode(F.unhex(p), "ISO-8859-1")).otherwise(F.concat(F.lit("%"), p)))
    return F.when(F.length(c) == 0, "").otherwise(F.array_join(safe, ""))
