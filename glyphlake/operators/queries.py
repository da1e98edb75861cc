"""Coordinates, viewports, provenance, traces and inspectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphlake.functions import deflate, raster
from glyphlake.functions.geometry import channels_for, filter_bpp, filter_text, pass_offsets, row_bytes
from glyphlake.functions.perfile import per_file
from glyphlake.operators.reconstruct import _analyzed, decode_input

_HEADER = ("width", "height", "bit_depth", "color_type", "interlace")


def locate(pass_rows: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels (file_id, x, y, ..) with pass, stream_row, row_in_pass, local_x: a join on file and residues."""
    p = pass_offsets(pass_rows).where("width > 0").select("file_id", "pass", F.col("width").alias("pass_width"), F.col("height").alias("pass_height"), "x_start", "y_start", "x_step", "y_step", F.col("row_bytes").alias("pass_row_bytes"), "first_row", "first_byte")
    j = pixels.join(p, "file_id").where("x >= x_start and y >= y_start and (x - x_start) % x_step = 0 and (y - y_start) % y_step = 0")
    j = j.withColumns({"local_x": F.expr("(x - x_start) div x_step"), "row_in_pass": F.expr("(y - y_start) div y_step")}).where("local_x < pass_width and row_in_pass < pass_height")
    return j.withColumn("stream_row", F.col("first_row") + F.col("row_in_pass")).drop("pass_width", "pass_height", "x_start", "y_start", "x_step", "y_step", "first_row")


def coordinate_query(headers: DataFrame, pass_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (file_id, request, frame, pass, row, x, y, channel, sample_byte, packed_offset, packed_length, stage) with status, error and offsets at every stage.

    headers: the files whose stages could be computed.
    """
    r = requests.withColumnRenamed("pass", "want_pass").withColumnRenamed("row", "want_row")
    placed = locate(pass_rows, r.select("file_id", "request", "x", "y")).drop("x", "y")
    j = r.join(headers.select("file_id", *_HEADER), "file_id", "left").join(placed, ["file_id", "request"], "left")
    channels = channels_for(F.col("color_type"))
    j = j.withColumns({"channels": channels, "expected_pass": F.when(F.col("interlace") == 1, F.col("pass") + 1).otherwise(0)})
    chosen = F.coalesce("channel", F.lit(0))
    j = j.withColumn("pass_sample", (F.col("local_x") * F.col("channels") + chosen) * F.col("bit_depth"))
    j = j.withColumn("full_sample", (F.col("x") * F.col("channels") + chosen) * F.col("bit_depth"))
    verdicts = [
        (F.col("x").isNull() | F.col("y").isNull(), "no selection", ""),
        ((F.col("want_pass") > 7) | (F.coalesce("sample_byte", F.lit(0)) > 1) | ((F.col("sample_byte").isNotNull() | F.col("packed_offset").isNotNull()) & F.col("channel").isNull()), "out of range", "image coordinate has invalid sample addressing"),
        (F.col("frame") != 0, "not applicable", "frame is not available for static PNG analysis"),
        (F.col("stage").isin("file", "chunk", "trace"), "not applicable", "stage does not have image-coordinate semantics"),
        (F.col("width").isNull(), "error", "no stage data"),
        ((F.col("x") >= F.col("width")) | (F.col("y") >= F.col("height")), "out of range", "image coordinate is outside the image"),
        (F.col("stream_row").isNull(), "out of range", "image coordinate is not mapped to a scanline"),
        ((F.col("want_pass") != 0) & (F.col("want_pass") != F.col("expected_pass")), "out of range", "image pass does not match coordinate"),
        ((F.col("want_row") != 0) & (F.col("want_row") != F.col("row_in_pass")), "out of range", "pass-local row does not match coordinate"),
        (F.col("channel") >= F.col("channels"), "out of range", "channel is outside the image format"),
        (F.col("packed_offset").isNotNull() & ((F.col("bit_depth") >= 8) | (F.col("packed_length") != F.col("bit_depth")) | (F.col("pass_sample") % 8 != F.col("packed_offset"))), "out of range", "packed sample bits do not match image format"),
        (F.col("sample_byte").isNotNull() & (F.col("bit_depth") < 8), "out of range", "sample byte is not applicable to packed samples"),
        (F.col("sample_byte") >= F.floor(F.col("bit_depth") / 8), "out of range", "sample byte is outside the sample"),
    ]
    status, error = F.lit("ready"), F.lit("")
    for when, s, e in reversed(verdicts):
        status, error = F.when(F.coalesce(when, F.lit(False)), s).otherwise(status), F.when(F.coalesce(when, F.lit(False)), e).otherwise(error)
    j = j.withColumns({"status": status, "error": error})
    ready = F.col("status") == "ready"
    byte = F.coalesce("sample_byte", F.lit(0))
    whole = F.col("sample_byte").isNotNull()
    out = {
        "pass_index": F.col("pass").cast("int"), "pass_number": F.col("expected_pass").cast("int"), "stream_row": F.col("stream_row"), "row_in_pass": F.col("row_in_pass"), "local_x": F.col("local_x"), "channel_count": F.col("channels"),
        "filtered_data_offset": F.expr("first_byte + row_in_pass * (pass_row_bytes + 1) + 1") + F.floor(F.col("pass_sample") / 8) + byte,
        "unfiltered_data_offset": F.col("y") * row_bytes(F.col("width"), F.col("bit_depth"), F.col("color_type")) + F.floor(F.col("full_sample") / 8) + byte,
        "sample_bit_offset": F.when(whole, 0).otherwise(F.col("pass_sample") % 8), "unfiltered_sample_bit_offset": F.when(whole, 0).otherwise(F.col("full_sample") % 8),
        "sample_bit_length": F.when(whole, 8).otherwise(F.col("bit_depth")), "sample_byte_count": F.when(whole | (F.col("bit_depth") < 8), 1).otherwise(F.floor(F.col("bit_depth") / 8)).cast("int"),
        "native_sample_index": F.when(F.col("channel").isNotNull(), (F.col("y") * F.col("width") + F.col("x")) * F.col("channels") + F.col("channel")),
    }
    return j.select("file_id", "request", "status", "error", *[F.when(ready, v).alias(k) for k, v in out.items()])


def viewport(headers: DataFrame, sample_rows: DataFrame, requests: DataFrame, max_samples: int = 65536) -> tuple[DataFrame, DataFrame]:
    """(file_id, request, status, channels) of rectangles (file_id, request, stage, x, y, width, height), and the samples of those that are ready."""
    r = requests.select("file_id", "request", "stage", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("width").alias("w"), F.col("height").alias("h"))
    j = r.join(headers.select("file_id", "width", "height", channels_for(F.col("color_type")).alias("channels")), "file_id", "left")
    size = F.try_multiply(F.try_multiply("w", "h"), F.col("channels").cast("bigint"))
    status = (
        F.when(F.col("width").isNull(), "no stage").when(F.col("stage") != "native", "not applicable").when((F.col("w") <= 0) | (F.col("h") <= 0) | F.lit(max_samples <= 0), "out of range")
        .when(F.try_add("x0", "w").isNull() | F.try_add("y0", "h").isNull() | size.isNull() | (F.col("x0") < 0) | (F.col("y0") < 0) | (F.try_add("x0", "w") > F.col("width")) | (F.try_add("y0", "h") > F.col("height")), "out of range")
        .when(size > max_samples, "budget exceeded").otherwise("ready")
    )
    j = j.withColumn("status", status)
    ready = j.where("status = 'ready'").select("file_id", "request", "x0", "y0", "w", "h")
    cells = sample_rows.join(ready, "file_id").where("x >= x0 and x < x0 + w and y >= y0 and y < y0 + h").select("file_id", "request", "y", "x", "channel", "value")
    return j.select("file_id", "request", "status", "channels"), cells


def neighbourhood(headers: DataFrame, sample_rows: DataFrame, points: DataFrame) -> DataFrame:
    """Samples of the 3 by 3 pixels around points (file_id, request, x, y), clipped at the edges."""
    p = points.select("file_id", "request", F.col("x").alias("px"), F.col("y").alias("py"))
    inside = p.join(headers.select("file_id", "width", "height"), "file_id").where("px >= 0 and py >= 0 and px < width and py < height")
    return sample_rows.join(inside, "file_id").where("abs(x - px) <= 1 and abs(y - py) <= 1").select("file_id", "request", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"), "channel", "value")


def filter_formula(events: DataFrame, points: DataFrame, radius: int = 2) -> DataFrame:
    """Filter steps within ``radius`` bytes of points (file_id, request, stream_row, byte)."""
    return events.join(points, ["file_id", "stream_row"]).where(F.abs(F.col("idx") - F.col("byte")) <= radius).select("file_id", "request", "stream_row", "idx", (F.col("idx") == F.col("byte")).alias("selected"), "type", "raw", "a", "b", "c", "predictor", "recon")


def formula_text(step: DataFrame) -> DataFrame:
    """(file_id, request, idx, text) of filter steps."""
    text = F.format_string("%s: (%d + %d) mod 256 = %d", filter_text(F.col("type")), "raw", "predictor", "recon")
    return step.select("file_id", "request", "idx", text.alias("text"))


def stage_summary(headers: DataFrame) -> DataFrame:
    """(file_id, conditions): what is special about an image."""
    c = F.array_compact(F.array(F.when(F.col("interlace") == 1, "adam7"), F.when(F.col("color_type") == 3, "palette"), F.when(F.col("color_type").isin(4, 6), "alpha"), F.when(F.col("bit_depth") < 8, "packed"), F.when(F.col("bit_depth") == 16, "16-bit")))
    return headers.select("file_id", "width", "height", "bit_depth", "color_type", c.alias("conditions"))


def stage_values(headers: DataFrame, located: DataFrame, scanline_rows: DataFrame, sample_rows: DataFrame) -> DataFrame:
    """(file_id, request, channel, native, filtered, unfiltered): a pixel's values at every stage, hexadecimal where they are bytes."""
    h = headers.select("file_id", "bit_depth", channels_for(F.col("color_type")).alias("channels"))
    rows = located.join(h, "file_id").join(scanline_rows.select("file_id", "stream_row", "filtered", "unfiltered"), ["file_id", "stream_row"])
    rows = rows.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    first = F.expr("cast((local_x * channels + channel) * bit_depth div 8 + 1 as int)")
    n = F.greatest(F.lit(1), (F.col("bit_depth") / 8).cast("int"))
    rows = rows.withColumns({"f": F.hex(F.substring("filtered", first, n)), "u": F.hex(F.substring("unfiltered", first, n))})
    s = sample_rows.select("file_id", "x", "y", "channel", F.col("value").alias("native"))
    return rows.join(s, ["file_id", "x", "y", "channel"]).select("file_id", "request", "channel", "native", F.col("f").alias("filtered"), F.col("u").alias("unfiltered"))


def scanline_anchors(scanline_rows: DataFrame, interval: int) -> DataFrame:
    """(file_id, stream_row, offset): rows to resume from - the first of a pass, and each that starts ``interval`` bytes after the anchor before; one fold a file."""
    rows = scanline_rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("stream_row", "offset", "row_in_pass"))).alias("rows"))
    fold = f"""aggregate(rows, cast(array() as array<struct<stream_row:bigint,offset:bigint>>),
      (s, r) -> if(r.row_in_pass = 0 or r.offset - element_at(s, -1).offset >= {interval}, concat(s, array(named_struct('stream_row', r.stream_row, 'offset', r.offset))), s))"""
    return rows.select("file_id", F.expr(f"inline({fold})"))


def nearest_before(points: DataFrame, requests: DataFrame, at: str, wanted: str) -> DataFrame:
    """Requests with the greatest ``at`` of their file's points that isn't above ``wanted``: an as-of join as one aggregate."""
    p = points.select("file_id", F.col(at).alias("anchor"))
    return requests.join(p, "file_id").where(F.col("anchor") <= F.col(wanted)).groupBy(*requests.columns).agg(F.max("anchor").alias("anchor"))


def restore_scanlines(indexed: DataFrame, wanted: str, interval: int) -> DataFrame:
    """(file_id, stream_row, unfiltered, replay_bytes, error): the rows that ``wanted`` (an array expression over decode_input) names, replayed from anchors.

    An anchor stands at the first row of a pass and at each row that starts
    ``interval`` bytes after the anchor before; it keeps the row above it. A row is
    restored by the reverse filters from the last anchor on; replay_bytes are the
    bytes read for that. Everything happens in one pass over a file.
    """

    def rows(file_id, valid, stream, head, asked):
        found = _analyzed(valid, stream, head, plain=False)
        lines = found.scanlines if found.success else []
        anchors: list[tuple[int, bytes]] = []
        done, above, bpp = 0, b"", raster.bytes_per_pixel(head[8], head[9]) if found.success else 1
        for want in sorted(set(asked or ())):
            if want < 0 or want >= len(lines):
                yield file_id, want, None, None, found.error or "scanline out of range"
                continue
            # Anchors are laid as far as they are needed.
            for k in range(done, want + 1):
                r = lines[k]
                above = bytes(len(r["filtered"])) if r["row_in_pass"] == 0 else above
                if r["row_in_pass"] == 0 or r["offset"] - lines[anchors[-1][0]]["offset"] >= interval:
                    anchors.append((k, above))
                above = raster.unfilter(r["filter_type"], r["filtered"], above, bpp)
            done = max(done, want + 1)
            at, row = anchors[-1]
            for k in range(at, want + 1):
                row = raster.unfilter(lines[k]["filter_type"], lines[k]["filtered"], row, bpp)
            yield file_id, want, row, lines[want]["offset"] + lines[want]["length"] - lines[at]["offset"], ""

    df = decode_input(indexed).withColumn("_wanted", F.expr(wanted))
    return per_file(df, "file_id bigint, stream_row bigint, unfiltered binary, replay_bytes bigint, error string", rows, "file_id", "signature_valid", "stream", "head", "_wanted")


def bits_to_physical(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Physical bit spans (file_id, request, offset, bit_offset, bit_length) of stream bit ranges (file_id, request, begin, end), cut at segments."""
    s = segments.select("file_id", "physical_offset", "length", "logical_start")
    j = ranges.join(s, "file_id").where("begin < end and logical_start * 8 < end and begin < (logical_start + length) * 8")
    j = j.withColumns({"a": F.greatest("begin", F.col("logical_start") * 8), "z": F.least("end", (F.col("logical_start") + F.col("length")) * 8)})
    return j.select("file_id", "request", F.expr("physical_offset + a div 8 - logical_start").alias("offset"), (F.col("a") % 8).cast("int").alias("bit_offset"), (F.col("z") - F.col("a")).alias("bit_length"))


def pixel_provenance(headers: DataFrame, located: DataFrame, scanline_rows: DataFrame, token_rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_id, request, space, begin, end): where the bytes of located pixels (.., channel) come from.

    Native sample, reconstructed byte, filtered bytes (its own and those its
    filter looks at: left, above, above left, one step), inflated bytes, tokens,
    and their bits in the logical stream and in the file.
    """
    from glyphlake.operators.tracing import overlapping

    h = headers.select("file_id", "width", "bit_depth", "color_type", channels_for(F.col("color_type")).alias("channels"), filter_bpp(F.col("bit_depth"), F.col("color_type")).alias("bpp"), row_bytes(F.col("width"), F.col("bit_depth"), F.col("color_type")).alias("row_bytes"))
    rows = located.join(h, "file_id").join(scanline_rows.select("file_id", "stream_row", "offset", F.col("length").alias("row_length"), "filter_type"), ["file_id", "stream_row"])
    rows = rows.withColumn("byte", F.expr("(local_x * channels + channel) * bit_depth div 8")).withColumn("n", F.expr("greatest(1, bit_depth div 8)"))
    native = rows.select("file_id", "request", F.lit("native").alias("space"), F.expr("(y * width + x) * channels + channel").alias("begin")).withColumn("end", F.col("begin") + 1)
    plain = rows.select("file_id", "request", F.lit("reconstructed").alias("space"), F.expr("y * row_bytes + (x * channels + channel) * bit_depth div 8").alias("begin"), F.col("n")).select("file_id", "request", "space", "begin", (F.col("begin") + F.col("n")).alias("end"))
    own = F.expr("offset + 1 + byte")
    left = (F.col("byte") >= F.col("bpp")) & F.col("filter_type").isin(1, 3, 4)
    above = (F.col("row_in_pass") > 0) & F.col("filter_type").isin(2, 3, 4)
    corner = (F.col("byte") >= F.col("bpp")) & (F.col("row_in_pass") > 0) & (F.col("filter_type") == 4)
    # Rows of one pass lie one after another, so the row above begins a row's length before.
    fan = F.array_compact(F.array(own, F.when(left, own - F.col("bpp")), F.when(above, own - F.col("row_length")), F.when(corner, own - F.col("row_length") - F.col("bpp"))))
    filtered = rows.select("file_id", "request", F.explode(fan).alias("begin"), "n").select("file_id", "request", F.lit("filtered").alias("space"), "begin", (F.col("begin") + F.col("n")).alias("end")).distinct()
    inflated = filtered.withColumn("space", F.lit("inflated"))
    hit = overlapping(token_rows, inflated.select("file_id", "request", "begin", "end")).select("file_id", "request", "token_index").distinct()
    bits = hit.join(token_rows.select("file_id", F.col("idx").alias("token_index"), F.col("stream_bit_begin").alias("begin"), F.col("stream_bit_end").alias("end")), ["file_id", "token_index"])
    tokens = hit.select("file_id", "request", F.lit("token").alias("space"), F.col("token_index").alias("begin"), (F.col("token_index") + 1).alias("end"))
    logical = bits.select("file_id", "request", F.lit("logical_bit").alias("space"), "begin", "end")
    physical = bits_to_physical(segments, bits.select("file_id", "request", "begin", "end")).select("file_id", "request", F.lit("physical_bit").alias("space"), (F.col("offset") * 8 + F.col("bit_offset")).alias("begin"), (F.col("offset") * 8 + F.col("bit_offset") + F.col("bit_length")).alias("end"))
    out = native
    for part in (plain, filtered, inflated, tokens, logical, physical):
        out = out.unionByName(part)
    return out.dropDuplicates()


def trace_window(traces: DataFrame, block_rows: DataFrame, token_rows: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status, blocks and tokens of output windows (file_id, request, begin, end, max_tokens)."""
    j = requests.join(traces, "file_id", "left")
    bad = F.when((F.col("end") < F.col("begin")) | (F.col("end") > F.col("output_bytes")), "inflated query range is out of bounds").when(F.col("max_tokens") <= 0, "trace token budget must be non-zero").when(~F.col("success"), F.col("error"))
    j = j.withColumn("bad", F.when(F.col("success").isNull(), "trace artifacts unavailable").otherwise(bad))
    ok = j.where("bad is null").select("file_id", "request", "begin", "end", "max_tokens")
    b = ok.join(block_rows, "file_id").where("output_begin < end and begin < output_end").drop("begin", "end", "max_tokens")
    over = ok.join(token_rows, "file_id").where("output_begin < end and begin < output_end")
    ranked = over.withColumn("k", F.row_number().over(Window.partitionBy("file_id", "request").orderBy("idx")))
    kept = ranked.where("k <= max_tokens").drop("k", "begin", "end", "max_tokens")
    cut = ranked.where("k > max_tokens").select("file_id", "request").distinct().withColumn("truncated", F.lit(True))
    status = j.join(cut, ["file_id", "request"], "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    status = status.select("file_id", "request", F.when(F.col("bad").isNotNull(), "error").when(F.col("truncated"), "partial").otherwise("ready").alias("status"), F.coalesce("bad", F.when(F.col("truncated"), "trace token budget exceeded"), F.lit("")).alias("error"), "truncated")
    return status, b, kept


def input_spans(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, request, ord, space, offset, length, bit_offset, bit_length): logical and physical spans of stream bit ranges (file_id, request, ord, begin, end)."""
    some = ranges.where("begin < end")
    logical = some.selectExpr("file_id", "request", "ord", "'logical_deflate' as space", "begin div 8 as offset", "(end + 7) div 8 - begin div 8 as length", "begin % 8 as bit_offset", "end - begin as bit_length")
    s = segments.select("file_id", "physical_offset", F.col("length").alias("n"), "logical_start")
    j = some.join(s, "file_id").where("logical_start * 8 < end and begin < (logical_start + n) * 8")
    j = j.withColumns({"a": F.greatest("begin", F.col("logical_start") * 8), "z": F.least("end", (F.col("logical_start") + F.col("n")) * 8)})
    physical = j.selectExpr("file_id", "request", "ord", "'physical_file' as space", "physical_offset + a div 8 - logical_start as offset", "(z + 7) div 8 - a div 8 as length", "a % 8 as bit_offset", "z - a as bit_length")
    return logical.unionByName(physical)


def trace_text(status: DataFrame, blocks: DataFrame, tokens: DataFrame, traces: DataFrame, requests: DataFrame, segments: DataFrame, generation: int = 0, selection: str = "") -> DataFrame:
    """(file_id, request, text): a window's trace in a fixed order of lines, with the spans of its blocks and tokens."""
    from glyphlake.sources.sinks import percent_escaped

    key = ["file_id", "request"]
    short = F.when(F.col("kind") == "length_distance", "match").when(F.col("kind") == "end_of_block", "eob").otherwise("literal")
    span = F.concat_ws(",", "space", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("bit_offset").cast("string"), F.col("bit_length").cast("string"), F.lit("1"))
    of_blocks = input_spans(segments, blocks.select(*key, F.col("idx").alias("ord"), F.col("input_bit_begin").alias("begin"), F.col("input_bit_end").alias("end")))
    of_tokens = input_spans(segments, tokens.select(*key, F.col("idx").alias("ord"), F.col("stream_bit_begin").alias("begin"), F.col("stream_bit_end").alias("end")))

    def listed(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]).alias(name))

    def once(rows: DataFrame, name: str) -> DataFrame:
        """Distinct spans in order of first appearance."""
        return listed(rows.withColumn("t", F.concat(F.lit("span:"), span)).groupBy(*key, "t").agg(F.min(F.struct("ord", "offset")).alias("o")), "o", F.col("t"), name)

    in_block = of_blocks.where("space = 'physical_file'").groupBy(*key, "ord").agg(F.count("*").alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", span.alias("t")))), lambda x: F.concat(F.lit(","), x["t"])), "").alias("spans"))
    b = blocks.join(in_block, (blocks["file_id"] == in_block["file_id"]) & (blocks["request"] == in_block["request"]) & (blocks["idx"] == in_block["ord"]), "left").drop(in_block["file_id"], in_block["request"])
    numbers = lambda *c: [F.col(x).cast("string") for x in c]
    block_line = F.concat(F.lit("block:"), F.concat_ws(",", F.col("idx").cast("string"), "type", F.col("last").cast("int").cast("string"), *numbers("input_bit_begin", "input_bit_end", "output_begin", "output_end")), F.lit(",spans="), F.coalesce("k", F.lit(0)).cast("string"), F.coalesce("spans", F.lit("")))
    sources = F.array_join(F.transform("sources", lambda x: F.concat(F.lit(","), x["begin"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit(","), x["token_index"].cast("string"))), "")
    token_line = F.concat(F.lit("token:"), F.concat_ws(",", F.col("idx").cast("string"), short, *numbers("input_bit_begin", "input_bit_end", "output_begin", "output_end", "literal", "length", "distance", "match_source_begin", "match_source_end", "block_idx")), F.lit(",sources="), F.size("sources").cast("string"), sources)
    logical = of_blocks.unionByName(of_tokens.withColumn("ord", F.col("ord") + (1 << 40))).where("space = 'logical_deflate'")
    matches = tokens.select(*key, "idx", F.posexplode("sources").alias("k", "s")).withColumn("t", F.concat(F.lit("match:"), F.concat_ws(",", F.col("s.begin").cast("string"), F.col("s.end").cast("string"), F.col("s.token_index").cast("string")))).groupBy(*key, "t").agg(F.min(F.struct("idx", "k")).alias("o"))
    parts = {"blocks": listed(b, "idx", block_line, "blocks"), "tokens": listed(tokens, "idx", token_line, "tokens"), "logical": once(logical, "logical"), "physical": once(of_tokens.where("space = 'physical_file'"), "physical"), "matches": listed(matches, "o", F.col("t"), "matches")}
    j = status.join(requests.select(*key, "begin", "end"), key).join(traces.select("file_id", "output_bytes", "deflate_data_begin"), "file_id", "left")
    for p in parts.values():
        j = j.join(p, key, "left")
    none = F.expr("cast(array() as array<string>)")

    def section(name: str) -> list[Column]:
        rows = F.coalesce(F.col(name), none)
        return [F.array(F.concat(F.lit(f"{name}:"), F.size(rows).cast("string"))), rows]

    head = F.array(
        F.lit("trace-query-v1"), F.concat(F.lit("status:"), "status"), F.lit(f"generation:{generation}"), F.lit(f"selection:{selection}"), F.concat(F.lit("error:"), percent_escaped(F.col("error"))),
        F.concat(F.lit("range:"), F.col("begin").cast("string"), F.lit(","), F.col("end").cast("string")), F.concat(F.lit("output:"), F.coalesce("output_bytes", F.lit(0)).cast("string")),
        F.concat(F.lit("deflate-data-begin:"), F.coalesce("deflate_data_begin", F.lit(0)).cast("string")), F.concat(F.lit("truncated:"), F.col("truncated").cast("int").cast("string")),
    )
    lines = F.concat(head, *section("blocks"), *section("tokens"), *section("logical"), *section("physical"), *section("matches"))
    return j.select(*key, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def huffman_inspector_text(rows: DataFrame) -> DataFrame:
    """(file_id, text): one line of a file's tables."""
    part = F.concat_ws(",", F.col("block_idx").cast("string"), "mode", "kind", F.col("build_order").cast("string"), F.col("declared").cast("string"))
    g = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("build_order", part.alias("t")))).alias("r"))
    return g.select("file_id", F.concat(F.lit("tables="), F.size("r").cast("string"), F.lit("|"), F.array_join(F.transform("r", lambda x: x["t"]), "|")).alias("text"))


def decode_inspector_text(steps: DataFrame) -> DataFrame:
    """(file_id, text): one line of a file's decoding steps."""
    path = F.when(F.col("kind") == "length_distance", "match").when(F.col("kind") == "end_of_block", "eob").otherwise("literal")

    def sum_of(n: str) -> list[Column]:
        return [F.lit(f",{n}="), F.concat_ws("+", *[F.col(c).cast("string") for c in (n, f"{n}_base", f"{n}_extra_bits", f"{n}_extra_value")])]

    part = F.concat(F.col("token_index").cast("string"), F.lit(","), path, F.lit(",symbol="), F.coalesce(F.col("symbol").cast("string"), F.lit("-")), *sum_of("length"), *sum_of("distance"))
    g = steps.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("token_index", part.alias("t")))).alias("r"))
    return g.select("file_id", F.concat(F.lit("steps="), F.size("r").cast("string"), F.lit("|"), F.array_join(F.transform("r", lambda x: x["t"]), "|")).alias("text"))


def inspector_bundle(block_rows: DataFrame, entries: DataFrame, token_rows: DataFrame, selected: DataFrame) -> dict[str, DataFrame]:
    """The three inspectors of one generation."""
    return {"blocks": block_inspector(block_rows, selected), "huffman": huffman_inspector(block_rows, entries), "decode": decode_inspector(token_rows)}


def block_inspector(block_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Blocks of files with requests (file_id, request, offset): whether each is selected, and the output position in it."""
    j = selected.join(block_rows, "file_id")
    inside = (F.col("offset") >= F.col("output_begin")) & (F.col("offset") < F.col("output_end"))
    return j.select("file_id", "request", F.col("idx").alias("block_idx"), "type", "last", "input_bit_begin", "input_bit_end", "output_begin", "output_end", inside.alias("selected"), F.when(inside, F.col("offset")).alias("position"))


def block_inspector_text(rows: DataFrame) -> DataFrame:
    """(file_id, request, text): one line of a file's blocks."""
    part = F.concat(F.col("block_idx").cast("string"), F.lit(","), "type", F.lit(","), F.col("last").cast("int").cast("string"), F.lit(","), F.col("input_bit_begin").cast("string"), F.lit(":"), F.col("input_bit_end").cast("string"), F.lit(","), F.col("output_begin").cast("string"), F.lit(":"), F.col("output_end").cast("string"), F.lit(",current="), F.coalesce(F.col("position").cast("string"), F.lit("-")))
    g = rows.groupBy("file_id", "request").agg(F.sort_array(F.collect_list(F.struct("block_idx", part.alias("t")))).alias("r"), F.max(F.when(F.col("selected"), F.col("block_idx"))).alias("s"))
    return g.select("file_id", "request", F.concat(F.lit("selected_block="), F.coalesce(F.col("s").cast("string"), F.lit("-")), F.lit(";rows="), F.size("r").cast("string"), F.lit("|"), F.array_join(F.transform("r", lambda x: x["t"]), "|")).alias("text"))


def huffman_inspector(block_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_id, block_idx, mode, kind, build_order, declared): stored blocks' pseudo table, fixed blocks' two, dynamic blocks' three."""
    base = block_rows.select("file_id", F.col("idx").alias("block_idx"), F.col("type").alias("mode"))
    stored = base.where("mode = 'stored'").select("*", F.lit("none").alias("kind"), F.lit(2).cast("bigint").alias("declared"), F.lit(0).alias("o"))
    fixed = base.where("mode = 'fixed'").select("*", F.inline(F.array(F.struct(F.lit("literal_length").alias("kind"), F.lit(288).cast("bigint").alias("declared"), F.lit(0).alias("o")), F.struct(F.lit("distance").alias("kind"), F.lit(32).cast("bigint").alias("declared"), F.lit(1).alias("o")))))
    order = F.when(F.col("kind") == "code_length", 0).when(F.col("kind") == "literal_length", 1).otherwise(2)
    dynamic = base.where("mode = 'dynamic'").join(entries.groupBy("file_id", "block_idx", "kind").agg(F.count("*").alias("declared")), ["file_id", "block_idx"]).select("file_id", "block_idx", "mode", "kind", "declared", order.alias("o"))
    every = stored.unionByName(fixed).unionByName(dynamic)
    return every.withColumn("build_order", (F.row_number().over(Window.partitionBy("file_id").orderBy("block_idx", "o")) - 1).cast("bigint")).drop("o")


def _bases(table: tuple, first: int) -> Column:
    return F.array(*[F.struct(F.lit(first + k).alias("symbol"), F.lit(b).alias("base"), F.lit(e).alias("extra")) for k, (b, e) in enumerate(table)])


def decode_inspector(token_rows: DataFrame) -> DataFrame:
    """Tokens with symbol, base, extra bits and their value, for length and distance; a length of 258 is symbol 285."""
    def parts(value: str, table: tuple, first: int) -> Column:
        hit = F.element_at(F.filter(_bases(table, first), lambda t: t["base"] <= F.col(value)), -1)
        return F.when(F.col("kind") == "length_distance", hit)

    t = token_rows.withColumns({"l": parts("length", deflate.LENGTHS, 257), "d": parts("distance", deflate.DISTANCES, 0)})
    symbol = F.when(F.col("kind") == "literal", F.col("literal")).when(F.col("kind") == "end_of_block", 256).otherwise(F.col("l.symbol"))

    def extra(c: str, value: str) -> list[Column]:
        n = "length" if c == "l" else "distance"
        return [F.coalesce(F.col(f"{c}.base"), F.lit(0)).alias(f"{n}_base"), F.coalesce(F.col(f"{c}.extra"), F.lit(0)).alias(f"{n}_extra_bits"), F.coalesce(F.col(value) - F.col(f"{c}.base"), F.lit(0)).alias(f"{n}_extra_value")]

    return t.select("file_id", F.col("idx").alias("token_index"), "kind", symbol.alias("symbol"), "length", *extra("l", "length"), "distance", *extra("d", "distance"))


def literal_walk(token_rows: DataFrame, starts: DataFrame, max_depth: int = 8, max_nodes: int = 64) -> DataFrame:
    """(file_id, request, status, literal_token, depth, path): from a token (file_id, request, token_index) along first sources to its literal; file by file, over tokens and requests gathered by file.

    Budgets are met before a token is taken: max_depth steps and max_nodes tokens at
    most. 'error' means a cycle; 'not_found' a token or source that isn't there, or
    one without a literal behind it.
    """
    limit = min(max_depth, max_nodes)
    if limit <= 0:
        return starts.select("file_id", "request", F.lit("budget_exceeded").alias("status"), F.lit(None).cast("bigint").alias("literal_token"), F.lit(None).cast("int").alias("depth"), F.expr("cast(array() as array<bigint>)").alias("path"))
    nodes = token_rows.select("file_id", F.struct(F.col("idx").alias("token_index"), "kind", F.expr("get(sources, 0).token_index").alias("next")).alias("n")).groupBy("file_id").agg(F.collect_list("n").alias("nodes"))
    asked = starts.select("file_id", F.struct("request", "token_index").alias("s")).groupBy("file_id").agg(F.collect_list("s").alias("starts"))

    def rows(file_id, starts, nodes):
        at = {n["token_index"]: (n["kind"], n["next"]) for n in nodes or ()}
        for s in starts:
            index, path = s["token_index"], []
            while index in at and index not in path and len(path) < limit:
                path.append(index)
                kind, onward = at[index]
                if kind != "length_distance":
                    break
                index = onward
            if not path:
                yield file_id, s["request"], "not_found", None, None, None
                continue
            ready = kind == "literal"
            status = "ready" if ready else "not_found" if kind != "length_distance" or onward not in at else "budget_exceeded" if len(path) >= limit else "error"
            yield file_id, s["request"], status, path[-1] if ready else None, len(path) - 1, path

    types = {c: starts.schema[c].dataType.simpleString() for c in ("file_id", "request")}
    return per_file(asked.join(nodes, "file_id", "left"), f"file_id {types['file_id']}, request {types['request']}, status string, literal_token bigint, depth int, path array<bigint>", rows, "file_id", "starts", "nodes")


def navigation(token_rows: DataFrame, space: str) -> DataFrame:
    """(file_id, token_index, begin, end) in input bits or output bytes."""
    a, z = ("input_bit_begin", "input_bit_end") if space == "input" else ("output_begin", "output_end")
    return token_rows.select("file_id", F.col("idx").alias("token_index"), F.col(a).alias("begin"), F.col(z).alias("end"))


def limited(rows: DataFrame, cap: int, order: str) -> DataFrame:
    """The first ``cap`` rows of every file, with whether there were more."""
    w = Window.partitionBy("file_id")
    return rows.withColumns({"_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)}).where(F.col("_k") <= cap).withColumn("truncated", F.col("_n") > cap).drop("_k", "_n")
