"""Image geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.functions.raster import FILTERS, PASSES


def channels_for(color: Column) -> Column:
    return F.when(color == 0, 1).when(color == 2, 3).when(color == 3, 1).when(color == 4, 2).when(color == 6, 4).otherwise(0)


def _valid_depth(depth: Column) -> Column:
    return depth.isin(1, 2, 4, 8, 16)


def row_bytes(width: Column, depth: Column, color: Column) -> Column:
    """Bytes of a row; null where the format is invalid or the product overflows; 0 for no columns."""
    bits = F.try_multiply(F.try_multiply(width.cast("bigint"), channels_for(color).cast("bigint")), depth.cast("bigint"))
    return F.when(_valid_depth(depth) & (channels_for(color) > 0), F.floor(F.try_add(bits, F.lit(7).cast("bigint")) / 8).cast("bigint")).cast("bigint")


def filter_bpp(depth: Column, color: Column) -> Column:
    """Bytes between a byte and its left neighbour."""
    return F.when(_valid_depth(depth) & (channels_for(color) > 0), F.greatest(F.lit(1), F.ceil(channels_for(color) * depth / 8).cast("int")))


def filter_text(kind: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, FILTERS)), F.when(kind.between(0, 4), kind)), F.lit("unknown"))


def paeth(a: Column, b: Column, c: Column) -> Column:
    p = a + b - c
    x, y, z = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((x <= y) & (x <= z), a).when(y <= z, b).otherwise(c)


def predictor(kind: Column, a: Column, b: Column, c: Column) -> Column:
    return F.when(kind == 1, a).when(kind == 2, b).when(kind == 3, F.floor((a + b) / 2).cast("int")).when(kind == 4, paeth(a, b, c)).otherwise(0)


def reconstruct(kind: Column, x: Column, a: Column, b: Column, c: Column) -> Column:
    return F.pmod(x + predictor(kind, a, b, c), F.lit(256))


def packed_sample(byte: Column, depth: Column, bit_offset: Column) -> Column:
    """A sample of 1, 2 or 4 bits, the most significant bit first."""
    shift = (8 - depth - bit_offset).cast("int")
    return F.floor(byte / F.pow(F.lit(2), shift)).cast("int").bitwiseAND((F.pow(F.lit(2), depth) - 1).cast("int"))


def passes(headers: DataFrame) -> DataFrame:
    """One or seven passes of each header (file_id, width, height, bit_depth, color_type, interlace), without a join."""
    h = headers.where((F.col("width") > 0) & (F.col("height") > 0) & row_bytes(F.col("width"), F.col("bit_depth"), F.col("color_type")).isNotNull())

    def one(k: int, x0: int, y0: int, dx: int, dy: int) -> Column:
        return F.struct(F.lit(k).alias("pass"), *[F.lit(v).cast("bigint").alias(n) for n, v in (("x_start", x0), ("y_start", y0), ("x_step", dx), ("y_step", dy))])

    every = F.when(F.col("interlace") == 1, F.array(*[one(k, *p) for k, p in enumerate(PASSES)])).otherwise(F.array(one(0, 0, 0, 1, 1)))
    p = h.select("*", F.inline(every))
    w = F.greatest(F.lit(0), F.ceil((F.col("width") - F.col("x_start")) / F.col("x_step"))).cast("bigint")
    ht = F.greatest(F.lit(0), F.ceil((F.col("height") - F.col("y_start")) / F.col("y_step"))).cast("bigint")
    p = p.withColumns({"w": w, "h": ht})
    some = (F.col("w") > 0) & (F.col("h") > 0)
    row = row_bytes(F.when(some, F.col("w")).otherwise(0), F.col("bit_depth"), F.col("color_type"))
    p = p.select("file_id", "pass", F.when(some, F.col("w")).otherwise(0).cast("bigint").alias("width"), F.when(some, F.col("h")).otherwise(0).cast("bigint").alias("height"), "x_start", "y_start", "x_step", "y_step", row.alias("row_bytes"))
    filtered = F.when(F.col("width") > 0, F.col("row_bytes") + 1).otherwise(0).cast("bigint")
    return p.withColumn("filter_row_bytes", filtered).withColumn("total_bytes", F.col("filter_row_bytes") * F.col("height"))


def pass_offsets(pass_rows: DataFrame) -> DataFrame:
    """Passes with first_row and first_byte: where each begins among the stream's rows and filtered bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    return pass_rows.withColumns({"first_row": F.coalesce(F.sum("height").over(w), F.lit(0)).cast("bigint"), "first_byte": F.coalesce(F.sum("total_bytes").over(w), F.lit(0)).cast("bigint")})


def total_pixels(pass_rows: DataFrame) -> DataFrame:
    return pass_rows.groupBy("file_id").agg(F.try_sum(F.try_multiply("width", "height")).alias("pixels"))
