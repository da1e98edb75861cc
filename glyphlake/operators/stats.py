"""Aggregations over files' chunks, rows, blocks and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Budgets, and the kinds that always have a row.
MAX_SAMPLES, MAX_TYPES, MAX_VALUES = 1 << 20, 1024, 65536
BLOCK_KINDS, TOKEN_KINDS = ("stored", "fixed", "dynamic"), ("literal", "length_distance", "end_of_block")


def chunk_stats(chunk_rows: DataFrame, *by: str) -> DataFrame:
    """Count and data bytes by type and over all (type null), in total or by further columns: one pass with grouping sets."""
    keys = [*by, "type"]
    grouped = chunk_rows.groupingSets([keys, list(by)], *keys) if by else chunk_rows.rollup("type")
    return grouped.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("data_length"), F.lit(0)).alias("data_bytes"))


def _dense(kinds: tuple[str, ...], name: str, rows: DataFrame) -> DataFrame:
    """Rows for every kind, zeros where there is none."""
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], f"{name} {'int' if isinstance(kinds[0], int) else 'string'}")
    out = every.join(rows, name, "left")
    return out.select(name, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in rows.columns if c != name])


def filter_stats(scanline_rows: DataFrame) -> DataFrame:
    """Rows and bytes of the five filter types."""
    g = scanline_rows.groupBy("filter_type").agg(F.count("*").alias("rows"), F.sum(F.col("length") - 1).alias("bytes"))
    return _dense((0, 1, 2, 3, 4), "filter_type", g)


def invalid_filters(scanline_rows: DataFrame) -> DataFrame:
    return scanline_rows.agg(F.count_if(~F.col("filter_type").between(0, 4)).alias("invalid_rows"))


def block_stats(block_rows: DataFrame) -> DataFrame:
    g = block_rows.groupBy("type").agg(F.count("*").alias("blocks"), F.sum(F.col("input_bit_end") - F.col("input_bit_begin")).alias("compressed_bits"), F.sum(F.col("output_end") - F.col("output_begin")).alias("output_bytes"))
    return _dense(BLOCK_KINDS, "type", g)


def token_stats(token_rows: DataFrame) -> DataFrame:
    g = token_rows.groupBy("kind").agg(F.count("*").alias("tokens"), F.sum(F.col("input_bit_end") - F.col("input_bit_begin")).alias("input_bits"), F.sum(F.col("output_end") - F.col("output_begin")).alias("output_bytes"))
    return _dense(TOKEN_KINDS, "kind", g)


def histogram(token_rows: DataFrame, column: str) -> DataFrame:
    """Exact counts of lengths or distances."""
    return token_rows.where((F.col("kind") == "length_distance") & (F.col(column) > 0)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def per_mille(compressed: Column, inflated: Column) -> Column:
    """Thousandths of the inflated size, rounded down; 0 without totals or on overflow."""
    return F.coalesce(F.when((compressed > 0) & (inflated > 0), F.floor(F.try_divide(F.try_multiply(compressed, F.lit(1000)), inflated)).cast("bigint")), F.lit(0)).cast("bigint")


def compression(segments: DataFrame, traces: DataFrame) -> DataFrame:
    """(file_id, compressed_bytes, inflated_bytes, per_mille)."""
    c = segments.groupBy("file_id").agg(F.sum("length").alias("compressed_bytes"))
    return c.join(traces.select("file_id", F.col("output_bytes").alias("inflated_bytes")), "file_id").withColumn("per_mille", per_mille(F.col("compressed_bytes"), F.col("inflated_bytes")))


def budget_status(rows: DataFrame, key: str, max_samples: int = MAX_SAMPLES, max_keys: int = MAX_TYPES) -> DataFrame:
    """(file_id, status): whether a file's samples and distinct keys stay within the budgets, and their sizes add up."""
    g = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))
    return g.select("file_id", F.when((F.col("n") > max_samples) | (F.col("keys") > max_keys), "budget_exceeded").otherwise("ready").alias("status"))


def checked_sum_status(rows: DataFrame, column: str) -> DataFrame:
    """(file_id, status, total): 'overflow' where the sum leaves 64 bits, 'invalid_input' for a negative value."""
    g = rows.groupBy("file_id").agg(F.try_sum(column).alias("total"), F.min(column).alias("least"))
    return g.select("file_id", F.when(F.col("least") < 0, "invalid_input").when(F.col("total").isNull(), "overflow").otherwise("ready").alias("status"), "total")


def build_status(parts: list[tuple[str, DataFrame]], max_samples: int = MAX_SAMPLES, max_keys: int = MAX_TYPES) -> DataFrame:
    """(file_id, status, failed, total): the outcome of statistics over families of rows (file_id, key, amount), in their order.

    The first family that fails decides: 'invalid_input' for a negative amount,
    'budget_exceeded' for too many rows or keys, 'overflow' where its amounts, or the
    total with those before, leave 64 bits; total is that of the families before it.
    A file with no rows in a family has nothing to fail there.  Distinct keys are
    counted in two steps of partial sums, so one hot file needs no set in memory.
    """
    counted = []
    for k, (name, rows) in enumerate(parts):
        by_key = rows.groupBy("file_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,0)")).alias("sum"), F.min("amount").alias("least"))
        g = by_key.groupBy("file_id").agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum("sum").alias("sum"), F.min("least").alias("least"))
        status = F.when(F.col("least") < 0, "invalid_input").when((F.col("n") > max_samples) | (F.col("keys") > max_keys), "budget_exceeded").otherwise("ready")
        counted.append(g.select("file_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("family"), status.alias("status"), "sum").alias("f")))
    every = counted[0]
    for c in counted[1:]:
        every = every.unionAll(c)
    start = F.struct(F.lit("ready").alias("status"), F.lit(None).cast("string").alias("failed"), F.lit(0).cast("bigint").alias("total"))

    def step(state: Column, f: Column) -> Column:
        total = (state["total"].cast("decimal(38,0)") + f["sum"]).try_cast("bigint")
        now = F.when(f["status"] != "ready", f["status"]).when(total.isNull(), "overflow").otherwise("ready")
        after = F.struct(now.alias("status"), F.when(now != "ready", f["family"]).alias("failed"), F.when(now == "ready", total).otherwise(state["total"]).alias("total"))
        return F.when(state["status"] == "ready", after).otherwise(state)

    folded = every.groupBy("file_id").agg(F.sort_array(F.collect_list("f")).alias("f"))
    return folded.select("file_id", F.aggregate("f", start, step).alias("s")).select("file_id", "s.*")


def collect(indexed: DataFrame) -> DataFrame:
    """(family, key, n, input, output): statistics of chunks, filters, blocks and tokens in one table."""
    from glyphlake.operators import reconstruct, structure, tracing

    streams = structure.with_stream(indexed).select("file_id", "stream")
    zero = F.lit(0).cast("bigint")
    parts = [
        chunk_stats(structure.chunks(indexed)).where("type is not null").select(F.lit("chunk").alias("family"), F.col("type").alias("key"), F.col("chunks").alias("n"), F.col("data_bytes").cast("bigint").alias("input"), zero.alias("output")),
        filter_stats(reconstruct.scanlines(indexed)).select(F.lit("filter").alias("family"), F.col("filter_type").cast("string").alias("key"), F.col("rows").alias("n"), F.col("bytes").alias("input"), zero.alias("output")),
        block_stats(tracing.blocks(streams)).select(F.lit("block").alias("family"), F.col("type").alias("key"), F.col("blocks").alias("n"), F.col("compressed_bits").alias("input"), F.col("output_bytes").alias("output")),
        token_stats(tracing.tokens(streams)).select(F.lit("token").alias("family"), F.col("kind").alias("key"), F.col("tokens").alias("n"), F.col("input_bits").alias("input"), F.col("output_bytes").alias("output")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_rank(rows: DataFrame, value: str, per_cent: int, *by: str) -> DataFrame:
    """The value whose rank is the ceiling of n * per_cent / 100."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({per_cent / 100}) within group (order by {value})").alias("value"))


def threshold_gate(measured: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(scenario, metric, verdict): measured values against ceilings, both ways."""
    j = measured.alias("m").join(ceilings.alias("c"), ["scenario", "metric"], "full")
    verdict = F.when(F.col("c.maximum").isNull(), "missing config").when(F.col("m.value").isNull(), "missing scenario").when(F.col("m.value") != F.floor("m.value"), "not an integer").when(F.col("m.value") > F.col("c.maximum"), "over maximum").otherwise("ok")
    return j.select("scenario", "metric", verdict.alias("verdict"))
