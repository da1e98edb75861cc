"""Byte sources: files, memory, bounded reads, hex windows and the persisted index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FILE_COLUMNS = ("file_id", "path", "length", "content")


def read_files(spark: SparkSession, path: str, max_length: int | None = None) -> DataFrame:
    """Files as rows; the limit on length is pushed into the scan, and content is read only where it is used."""
    df = spark.read.format("binaryFile").load(path)
    if max_length is not None:
        df = df.where(F.col("length") <= max_length)
    return df.select(F.xxhash64("path").alias("file_id"), "path", "length", "content")


def memory_files(spark: SparkSession, items: list[tuple[int, bytes]]) -> DataFrame:
    """Files from bytes at hand."""
    rows = [(k, f"memory/{k}", len(b), bytearray(b)) for k, b in items]
    return spark.createDataFrame(rows, "file_id bigint, path string, length bigint, content binary")


def bounded_read(content: Column, offset: Column, length: Column) -> Column:
    """The bytes [offset, offset + length); null outside the source; a length of zero is valid at its end."""
    inside = (offset >= 0) & (length >= 0) & (F.try_add(offset, length) <= F.octet_length(content))
    return F.when(inside, F.substring(content, (offset + 1).cast("int"), length.cast("int")))


def u32(b: Column) -> Column:
    """A big-endian unsigned integer of four bytes."""
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def u8(content: Column, offset) -> Column:
    """The byte at an offset, as an integer."""
    return F.conv(F.hex(F.substring(content, offset + 1, F.lit(1)) if isinstance(offset, Column) else F.substring(content, offset + 1, 1)), 16, 10).cast("int")


def missing_paths(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """Requested paths that the scan didn't deliver."""
    return requested.select("path").join(loaded.select("path"), "path", "left_anti")


def hex_window(df: DataFrame, column: str, offset: int, length: int, name: str) -> DataFrame:
    """(file_id, name, status, size, bytes): a window on one of a file's byte streams; 'unavailable' where it isn't there."""
    c = F.col(column)
    size = F.octet_length(c).cast("bigint")
    status = F.when(c.isNull(), "unavailable").when(F.lit(offset) > size, "error").otherwise("ready")
    data = F.substring(c, offset + 1, length)
    return df.select("file_id", F.lit(name).alias("name"), status.alias("status"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), F.when(status == "ready", data).alias("bytes"))


def hex_dump(df: DataFrame, column: str) -> DataFrame:
    """(file_id, offset, hex, ascii): sixteen bytes a line."""
    c = F.col(column)
    lines = F.sequence(F.lit(0), F.floor((F.octet_length(c) - 1) / 16).cast("int"))
    rows = df.where(F.octet_length(c) > 0).select("file_id", c.alias("c"), F.explode(lines).alias("line"))
    part = F.expr("substring(c, line * 16 + 1, 16)")
    spaced = F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 "))
    text = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    return rows.select("file_id", (F.col("line") * 16).cast("bigint").alias("offset"), spaced.alias("hex"), text.alias("ascii"))


INDEX_VERSION = 1
# Characters of a part of a key, entries and bytes of a file's index.
_MAX_KEY, _MAX_ENTRIES, _MAX_BYTES = 4096, 10**6, 64 << 20


def cache_key(*parts: str) -> str:
    """One key of the parts that an index depends on."""
    if any(len(p) > _MAX_KEY for p in parts):
        raise ValueError("a part of the key is too long")
    import hashlib

    return hashlib.sha256("\0".join([str(INDEX_VERSION), *parts]).encode()).hexdigest()


def store_index(index: DataFrame, root: str, key: str) -> None:
    """Write an index (blocks or access points) under its key; each file's entries and their bytes are bounded.

    The rows go to a folder beside the target, are checked there and renamed, so a
    reader never meets half an index; a writer lost between removing the former one
    and renaming leaves none, which is a miss.
    """
    spark = index.sparkSession
    fresh = f"{root}/.{key}-{uuid.uuid4().hex}"
    index.withColumn("cache_key", F.lit(key)).write.parquet(fresh)
    written = spark.read.parquet(fresh)
    path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = path(f"{root}/{key}"), path(fresh)
    fs = new.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("binary", "string") else F.lit(8) for c, t in index.dtypes]
    sizes = written.groupBy("file_id").agg(F.count("*").alias("entries"), F.sum(sum(width[1:], width[0])).alias("bytes"))
    if sizes.where((F.col("entries") > _MAX_ENTRIES) | (F.col("bytes") > _MAX_BYTES)).limit(1).count():
        fs.delete(new, True)
        raise ValueError("an index has too many entries or bytes")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"can't rename {fresh}")


def load_index(spark: SparkSession, root: str, key: str, schema: str) -> tuple[str, DataFrame | None]:
    """('hit', rows), ('miss', None) or ('invalid', None)."""
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import _parse_datatype_string

    try:
        df = spark.read.parquet(f"{root}/{key}")
    except AnalysisException as e:
        return ("miss" if "PATH_NOT_FOUND" in str(e) else "invalid"), None
    want = {(f.name, f.dataType.simpleString()) for f in _parse_datatype_string(schema).fields}
    if not want <= {(n, t) for n, t in df.dtypes} or "cache_key" not in df.columns:
        return "invalid", None
    return "hit", df.where(F.col("cache_key") == key).drop("cache_key")
