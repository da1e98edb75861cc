"""Sources, sinks, selections, services, the command line and streaming."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphlake import cli, services
from glyphlake.functions import geometry as G
from glyphlake.operators import queries as Q, reconstruct as R, rules, selection as S, stats, structure, tracing
from glyphlake.sources import encode as E, files, sinks
from glyphlake.sources.carriers import FAULTS, broken_file
from glyphlake.streaming import ingest


@pytest.fixture(scope="module")
def indexed(spark):
    items = [(1, E.image(8, 5, 8, 6)[0]), (2, E.image(16, 12, 2, 0, True)[0]), (3, E.image(64, 32, 8, 2, split=200)[0]), (4, b"no image")]
    return structure.index_files(files.memory_files(spark, items)).cache()


def test_clean_chunk_json(spark):
    clean = E.png(E.ihdr(1, 1, 8, 6), b"\x78\x9c" + b"\x11" * 6)
    i = structure.index_files(files.memory_files(spark, [(1, clean)]))
    got = json.loads(sinks.inspect_json(i).first()["json"])
    assert list(got) == ["file", "size", "signature_valid", "chunks", "issues"]
    assert got["size"] == 65 and [c["header_offset"] for c in got["chunks"]] == [8, 33, 53] and got["issues"] == []


def test_json_text_escapes(spark):
    odd = 'q"\\\n\t\r\b\f\x01\x1f é'
    row = spark.createDataFrame([(odd,)], "s string").select(sinks.json_text(F.col("s")).alias("j"), sinks.percent_escaped(F.col("s")).alias("p")).first()
    assert json.loads(row["j"]) == odd and "\\u0001" in row["j"].lower()
    assert row["p"].startswith("q%22%5C%0A") and row["p"].endswith("%20%C3%A9")


def test_rule_list_is_whole():
    assert len(rules.RULES) == 32


def test_single_faults(spark):
    rows = rules.validate(structure.index_files(files.memory_files(spark, [(k, broken_file(f, b"abcdef")) for k, f in enumerate(FAULTS)]))).collect()
    for r in rows:
        found = {i["rule_id"] for i in r["report"]}
        fault = FAULTS[r["file_id"]]
        want = {"none": set(), "chunk_truncated": {"chunk_truncated", "iend_required"}, "decoded_image_overflow": {"decoded_image_budget"}, "idat_zlib_header_truncated": {"idat_zlib_header_truncated", "idat_adler_truncated"}}.get(fault, {fault})
        assert found - {"idat_required"} == want - {"idat_required"}


def test_adler_split_over_chunks(spark):
    raw = b"\0" + b"abcdefgh"
    stream = E.stored_stream(raw)
    data = E.SIGNATURE + E.chunk(b"IHDR", E.ihdr(8, 1, 8, 0)) + E.chunk(b"IDAT", stream[:-2]) + E.chunk(b"IDAT", stream[-2:]) + E.chunk(b"IEND", b"")
    i = structure.index_files(files.memory_files(spark, [(1, data)]))
    for inflated, want in ((raw, []), (raw + b"x", [41 + len(stream) - 4])):
        v = rules.validate(i.withColumn("inflated", F.lit(bytearray(inflated))), "inflated", "integrity").first()
        assert [x["offset"] for x in v["report"]] == want


def test_geometry_values(spark):
    rows = [(3, 8, 6, 12), (8, 1, 0, 1), (8, 2, 0, 2), (8, 4, 3, 4), (3, 16, 2, 18), (5, 8, 0, 5), (3, 3, 6, None), (3, 8, 5, None), (0, 8, 6, 0)]
    d = spark.createDataFrame(rows, "w bigint, d int, c int, want bigint")
    assert all(r["got"] == r["want"] for r in d.select("want", G.row_bytes(F.col("w"), F.col("d"), F.col("c")).alias("got")).collect())
    big = spark.createDataFrame([((1 << 62), 16, 6)], "w bigint, d int, c int").select(G.row_bytes(F.col("w"), F.col("d"), F.col("c")).alias("x")).first()
    assert big["x"] is None
    b = spark.createDataFrame([(0b11100100, 2, k) for k in (0, 2, 4, 6)], "b int, d int, o int").select(G.packed_sample(F.col("b"), F.col("d"), F.col("o")).alias("v")).collect()
    assert [r["v"] for r in b] == [3, 2, 1, 0]


def test_stages_and_delivered(spark, indexed):
    s = {r["file_id"]: r for r in R.stages(indexed).collect()}
    assert s[1]["success"] and s[2]["success"] and s[3]["success"] and s[4]["error"] == "invalid PNG signature"
    truth = E.pattern(8, 5, 8, 6)
    for r in R.delivered(indexed.where("file_id = 1")).collect():
        assert (r["r"], r["g"], r["b"], r["a"]) == tuple(truth[r["y"], r["x"]])
    two = {(r["y"], r["x"]): r["r"] for r in R.delivered(indexed.where("file_id = 2")).collect()}
    assert all(v == int(E.pattern(16, 12, 2, 0)[y, x, 0]) * 85 for (y, x), v in two.items())


def test_coordinate_statuses(spark, indexed):
    one = [("file_id", "bigint"), ("request", "int"), ("frame", "int"), ("pass", "int"), ("row", "int"), ("x", "bigint"), ("y", "bigint"), ("channel", "int"), ("sample_byte", "int"), ("packed_offset", "int"), ("packed_length", "int"), ("stage", "string")]
    rows = [
        (1, 0, 0, 0, 0, 3, 2, 1, None, None, None, "native"), (1, 1, 1, 0, 0, 3, 2, None, None, None, None, "native"), (1, 2, 0, 0, 0, 3, 2, None, None, None, None, "trace"), (1, 3, 0, 0, 0, 8, 0, None, None, None, None, "native"),
        (1, 4, 0, 0, 0, 3, 2, 4, None, None, None, "native"), (2, 5, 0, 0, 0, 8, 8, 0, None, 2, 2, "native"), (2, 6, 0, 3, 0, 8, 8, None, None, None, None, "native"), (1, 7, 0, 0, 0, None, None, None, None, None, None, "native"), (4, 8, 0, 0, 0, 1, 1, None, None, None, None, "native"), (1, 9, 0, 0, 0, 1, 1, None, 1, None, None, "native"),
    ]
    h = structure.ihdr(indexed)
    got = {r["request"]: r for r in Q.coordinate_query(h, G.passes(h), spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in one))).collect()}
    assert [got[k]["status"] for k in range(10)] == ["ready", "not applicable", "not applicable", "out of range", "out of range", "ready", "out of range", "no selection", "error", "out of range"]
    assert got[0]["filtered_data_offset"] == 2 * 33 + 1 + 13 and got[0]["native_sample_index"] == (2 * 8 + 3) * 4 + 1
    assert (got[5]["pass_number"], got[5]["local_x"], got[5]["row_in_pass"], got[5]["sample_bit_offset"]) == (1, 1, 1, 2)
    assert got[6]["error"] == "image pass does not match coordinate" and got[8]["error"] == "no stage data"


def test_provenance_fans_in_by_filter(spark, indexed):
    one = indexed.where("file_id = 1")
    h = structure.ihdr(one)
    located = Q.locate(G.passes(h), one.select("file_id", F.lit(0).alias("request"), F.lit(3).cast("bigint").alias("x"), F.explode(F.array(F.lit(2).cast("bigint"), F.lit(4).cast("bigint"))).alias("y")).withColumn("request", F.col("y").cast("int"))).withColumn("channel", F.lit(0))
    s = structure.with_stream(one).select("file_id", "stream")
    p = Q.pixel_provenance(h, located, R.scanlines(one), tracing.tokens(s), structure.idat_segments(one)).where("space = 'filtered'").collect()
    at = lambda y, b: y * 33 + 1 + b
    # Row 2 looks up; row 4 looks left, up and up left.
    assert sorted(r["begin"] for r in p if r["request"] == 2) == [at(1, 12), at(2, 12)]
    assert sorted(r["begin"] for r in p if r["request"] == 4) == [at(3, 8), at(3, 12), at(4, 8), at(4, 12)]


def test_extract_in_the_middle(spark):
    raw = E.filtered_stream(E.pattern(300, 200, 8, 2), 8, 2)
    streams = spark.createDataFrame([(1, bytearray(E.zlib_stream(raw, 6)))], "file_id bigint, stream binary")
    points = tracing.access_points(streams, 1000)
    ranges = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 100_000, 5000), (1, 2, len(raw) - 3, 3), (1, 3, len(raw) - 3, 30)], "file_id bigint, request bigint, offset bigint, length bigint")
    got = {r["request"]: r for r in tracing.extract_output(points, streams, ranges).collect()}
    for k, o, n in ((0, 0, 10), (1, 100_000, 5000), (2, len(raw) - 3, 3)):
        assert got[k]["success"] and got[k]["data"] == raw[o : o + n]
    assert got[3]["error"] == "output range out of bounds"


def test_extract_refuses_other_sources(spark):
    # Skewed letters make several dynamic blocks, whose borders lie inside bytes.
    r = random.Random(1)
    stream = E.zlib_stream(bytes(r.choices(b"abcdefgh", [30, 20, 10, 5, 3, 2, 1, 1], k=400_000)), 6)
    points = tracing.access_points(spark.createDataFrame([(1, bytearray(stream))], "file_id bigint, stream binary"), 1000)
    primed = next(p for p in points.collect() if p["prime_bits"])
    at = primed["input_byte"] - 1
    for other, error in ((stream[:at] + bytes([stream[at] ^ 0x80]) + stream[at + 1 :], "source changed at the access point"), (stream[: primed["input_byte"]], "source too short for the access point"), (b"\0\0" + stream[2:], "source changed since indexing"), (b"x", "source too short for the indexed stream")):
        one = spark.createDataFrame([(1, 0, primed["output_offset"], 1)], "file_id bigint, request bigint, offset bigint, length bigint")
        assert tracing.extract_output(points, spark.createDataFrame([(1, bytearray(other))], "file_id bigint, stream binary"), one).first()["error"] == error


def test_inspector_texts(spark, indexed):
    s = structure.with_stream(indexed.where("file_id = 3")).select("file_id", "stream")
    requests = s.select("file_id", F.lit(0).alias("request"), F.lit(0).cast("bigint").alias("begin"), F.lit(500).cast("bigint").alias("end"), F.lit(8).alias("max_tokens"))
    traces, blocks = tracing.traces(s), tracing.blocks(s)
    w = Q.trace_window(traces, blocks, tracing.tokens(s), requests)
    a, b = (Q.trace_text(*w, traces, requests, structure.idat_segments(indexed), 3, "node:17;stage:trace").first()["text"] for _ in range(2))
    lines = a.split("\n")
    assert a == b and lines[:6] == ["trace-query-v1", "status:partial", "generation:3", "selection:node:17;stage:trace", "error:trace%20token%20budget%20exceeded", "range:0,500"]
    assert "truncated:1" in lines and a.count("\ntoken:") == 8 and a.endswith("\n")
    bundle = Q.inspector_bundle(blocks, tracing.huffman_entries(s), tracing.tokens(s), requests.withColumn("offset", F.lit(5)))
    assert all(df.count() for df in bundle.values())
    # A block over several segments has as many spans, and their bits add up.
    block = next(x for x in lines if x.startswith("block:0,"))
    parts = block.split(",spans=")[1].split(",")
    begin, end = (int(x) for x in block.split(",")[3:5])
    assert int(parts[0]) > 1 and sum(int(x) for x in parts[5::6]) == end - begin


def test_cache_hit_miss_invalid(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 5)], "file_id bigint, idx bigint, output_offset bigint")
    key = files.cache_key("path", "size", "time", "v", "i")
    schema = "file_id bigint, idx bigint, output_offset bigint"
    assert files.load_index(spark, str(tmp_path), key, schema)[0] == "miss"
    files.store_index(rows, str(tmp_path), key)
    status, back = files.load_index(spark, str(tmp_path), key, schema)
    assert status == "hit" and back.collect() == rows.collect()
    assert files.load_index(spark, str(tmp_path), key, "file_id bigint, missing string")[0] == "invalid"
    files.store_index(rows.withColumn("idx", F.lit(7).cast("bigint")), str(tmp_path), key)
    assert [r["idx"] for r in files.load_index(spark, str(tmp_path), key, schema)[1].collect()] == [7]
    with pytest.raises(ValueError):
        files.store_index(rows.withColumn("dictionary", F.expr("cast(repeat('x', 65 << 20) as binary)")), str(tmp_path), key)
    assert [r["idx"] for r in files.load_index(spark, str(tmp_path), key, schema)[1].collect()] == [7] and len(os.listdir(tmp_path)) == 1
    with pytest.raises(ValueError):
        files.cache_key("x" * 5000)


def test_selection_parser():
    text = "node:17;physical:1,2;physical_bit:3,4,5;logical:6,7;image:0,1,2,3,4;channel:2;packed_sample:2,2;stage:trace"
    s = S.parse(text)
    assert s["node"] == 17 and s["image"]["packed"] == {"bit_offset": 2, "bit_length": 2} and s["stage"] == "trace"
    assert S.parse("image:0,0,0,1,2,3")["image"]["channel"] == 3
    for bad in ("x", ":1", "node:", "node:1,2", "node:-1", "other:1", "stage:nope", "physical_bit:1,2,8", "channel:1", "image:0,0,0,1,2,3;channel:1", "image:0,0,0,1,2;image:0,0,0,1,2", "image:0,0,0,1,2;sample_byte:1", "image:0,0,0,1,2;channel:0;sample_byte:1;packed_sample:0,1", "image:0,0,0,1,2;channel:0;packed_sample:7,2", "node:99999999999999999999"):
        assert S.parse(bad) is None, bad
    assert S.parse("")["stage"] == "unknown"


def test_selection_validity_and_merge(spark):
    d = spark.createDataFrame([({"frame": 0, "pass": 8, "row": 0, "x": 0, "y": 0},), ({"frame": 0, "pass": 1, "row": 0, "x": 0, "y": 0, "channel": 1, "sample_byte": 1},), ({"frame": 0, "pass": 1, "row": 0, "x": 0, "y": 0, "sample_byte": 1},)], f"i {S.IMAGE}")
    assert [r[0] for r in d.select(S.coordinate_valid(F.col("i"))).collect()] == [False, True, False]
    m = spark.createDataFrame([(S.parse("node:1;physical:1,2;stage:native"), S.parse("physical:5,6;logical:1,1"))], f"a {S.SELECTION}, b {S.SELECTION}")
    assert m.select(S.serialize(S.merge(F.col("a"), F.col("b")))).first()[0] == "node:1;physical:5,6;logical:1,1;stage:native"


def test_statistics_values(spark):
    c = spark.createDataFrame([("IDAT", 100), ("IHDR", 13), ("IDAT", 20)], "type string, data_length bigint")
    assert {r["type"]: (r["chunks"], r["data_bytes"]) for r in stats.chunk_stats(c).collect()} == {"IDAT": (2, 120), "IHDR": (1, 13), None: (3, 133)}
    p = spark.createDataFrame([(65, 120), (0, 5), (5, 0), ((1 << 62), 7)], "a bigint, b bigint").select(stats.per_mille(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in p] == [541, 0, 0, 0]
    assert stats.invalid_filters(spark.createDataFrame([(0,), (7,)], "filter_type int")).first()[0] == 1


def test_scheduler_order_and_stale_results():
    got = []
    s = services.JobScheduler(100, lambda r: got.append((r.job_id, r.ok, r.error)))
    s.set_document_generation(2)
    assert s.submit(1, 2, "background", 40, lambda: 1) and s.submit(2, 2, "selection", 40, lambda: 1 / 0) and s.submit(3, 1, "viewport", 10, lambda: 3)
    assert s.submit(4, 2, "selection", 50, lambda: 4) is None
    s.submit(5, 2, "viewport", 1, lambda: 5)["cancelled"] = True
    assert s.run_pending() == 3 and [g[0] for g in got] == [2, 5, 1] and not got[0][1] and s.reserved == 0
    s.shutdown()
    assert s.submit(6, 2, "selection", 1, lambda: 1) is None


def test_artifact_store():
    s = services.ArtifactStore(10)
    assert s.put("a", b"12345") == "ok" and s.put("b", b"12345") == "ok" and s.pin("a")
    assert s.put("c", b"123") == "ok" and s.rebuild_needed("b") and s.contains("a")
    assert s.get("b") == ("evicted", None) and s.get("z") == ("not_found", None) and s.get("a", "tile") == ("format_mismatch", None)
    assert s.put("d", b"x" * 11) == "too_large" and s.unpin("a") and not s.unpin("a")


def test_coordinator_orchestrator_and_states(spark):
    f = files.memory_files(spark, [(1, E.image(64, 32, 8, 2)[0]), (2, b"junk")])
    c = services.QueryCoordinator()
    assert c.query_scanline(0)["error"] == "coordinator not open" and c.open(f, 1, 500)
    assert c.status_for(3) == "indexed" and c.query_scanline(3)["data"] == E.pattern(64, 32, 8, 2)[3].astype("uint8").tobytes() and c.status_for(3) == "ready"
    assert c.query_scanline(32)["error"] == "scanline out of range"
    t = services.TraceOrchestrator()
    assert t.submit(0, 0, 1, 1, 1)["status"] == "not indexed" and not t.open(f, 2, 100) and t.open(f, 1, 1 << 20)
    assert t.submit(9, 0, 1, 1, 1)["status"] == "stale generation" and t.submit(1, 0, 10**9, 1, 1)["status"] == "rejected"
    assert t.submit(1, 0, 10, 4, 1 << 20)["result"][0].first()["status"] in ("ready", "partial")
    s = services.TraceInspectorState()
    assert s.replace_document(1) and s.begin_loading(1) and s.mark_replaying(1) and s.publish(1, "ready", "b") and s.replace_document(2)
    assert not s.publish(1, "ready", "old") and s.status == "stale generation" and s.begin_loading(2) and s.cancel(2) and not s.cancel(2)


def test_command_line(spark, tmp_path, capsys):
    good, bad = tmp_path / "a.png", tmp_path / "b.png"
    good.write_bytes(E.image(8, 5, 8, 6)[0])
    bad.write_bytes(E.image(8, 5, 8, 6)[0] + b"xyz")
    assert cli.main(["validate", str(good)], spark) == 0 and json.loads(capsys.readouterr().out)["valid"]
    assert cli.main(["inspect", str(bad), "--json"], spark) == 3 and json.loads(capsys.readouterr().out)["issues"][0]["kind"] == "trailing_bytes_after_iend"
    assert cli.main(["inspect", str(good)], spark) == 0 and "IHDR data=13@16" in capsys.readouterr().out
    (tmp_path / "c.png").write_bytes(E.SIGNATURE + b"abc")
    assert cli.main(["validate", str(tmp_path / "c.png")], spark) == 2
    assert cli.main(["validate", str(tmp_path / "no.png")], spark) == 1 and cli.main(["frobnicate"], spark) == 2 and cli.main(["--version"], spark) == 0 and cli.main(["-V"], spark) == 0 and cli.main([], spark) == 2


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(E.image(8, 5, 8, 6)[0])
    (folder / "b.png").write_bytes(b"junk")
    ingest.store(ingest.validated(ingest.watch(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["path"][-5:]: r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.png": 0, "b.png": 2}


def test_limits_say_when_they_cut(spark):
    d = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 0)], "file_id bigint, idx bigint")
    got = Q.limited(d, 3, "idx").collect()
    assert sum(r["file_id"] == 1 for r in got) == 3 and all(r["truncated"] == (r["file_id"] == 1) for r in got)


def test_literal_walk_budgets_and_failures(spark):
    lit, match = "literal", "length_distance"
    tokens = spark.createDataFrame([(1, 0, lit, []), (1, 1, match, [(0,)]), (1, 2, match, [(1,)]), (1, 3, match, [(4,)]), (1, 4, match, [(3,)]), (1, 5, match, [(99,)]), (1, 6, "end_of_block", [])], "file_id bigint, idx bigint, kind string, sources array<struct<token_index:bigint>>")
    starts = spark.createDataFrame([(1, k, k) for k in (0, 1, 2, 3, 5, 6, 7)], "file_id bigint, request bigint, token_index bigint")

    def statuses(**budgets):
        return {r["request"]: (r["status"], r["literal_token"], r["depth"]) for r in Q.literal_walk(tokens, starts, **budgets).collect()}

    assert statuses() == {0: ("ready", 0, 0), 1: ("ready", 0, 1), 2: ("ready", 0, 2), 3: ("error", None, 1), 5: ("not_found", None, 0), 6: ("not_found", None, 0), 7: ("not_found", None, None)}
    one = statuses(max_depth=1)
    assert one[0][0] == "ready" and one[1][0] == "budget_exceeded" and one[5][0] == "not_found"
    assert statuses(max_nodes=2)[2][0] == "budget_exceeded" and statuses(max_nodes=2)[1][0] == "ready"
    assert {x[0] for x in statuses(max_depth=0).values()} == {"budget_exceeded"}


def test_rows_are_restored_from_anchors(spark):
    content, samples = E.image(9, 23, 8, 2, True)
    indexed = structure.index_files(spark.createDataFrame([(1, "a", len(content), bytearray(content))], "file_id bigint, path string, length bigint, content binary"))
    want = {r["stream_row"]: bytes(r["unfiltered"]) for r in R.scanlines(indexed).collect()}
    got = {r["stream_row"]: r for r in Q.restore_scanlines(indexed, f"sequence(-1L, {len(want)}L)", 60).collect()}
    assert all(bytes(got[k]["unfiltered"]) == v for k, v in want.items())
    assert got[-1]["error"] == got[len(want)]["error"] == "scanline out of range" and max(r["replay_bytes"] or 0 for r in got.values()) < 60 + 2 * 28


def test_streams_of_many_chunks_are_joined_in_linear_time(spark):
    import hashlib
    import time

    from glyphlake.operators.structure import with_stream

    data = bytes(range(256)) * (1 << 14)
    content = E.png(E.ihdr(1, 1, 8, 0), data, 512)
    df = structure.index_files(spark.createDataFrame([(1, "a", len(content), bytearray(content))], "file_id bigint, path string, length bigint, content binary"))
    with_stream(df).select(F.md5("stream")).collect()
    began = time.perf_counter()
    assert with_stream(df).select(F.md5("stream")).first()[0] == hashlib.md5(data).hexdigest()
    assert time.perf_counter() - began < 3
    assert structure.chunk_checksums(df).where("computed <> stored").count() == 0
    assert time.perf_counter() - began < 6


def test_nearest_before_is_an_as_of_join(spark):
    points = spark.createDataFrame([(1, 0), (1, 10), (2, 5)], "file_id bigint, at bigint")
    asked = spark.createDataFrame([(1, 9), (1, 10), (2, 4), (2, 50)], "file_id bigint, wanted bigint")
    assert {(r["file_id"], r["wanted"], r["anchor"]) for r in Q.nearest_before(points, asked, "at", "wanted").collect()} == {(1, 9, 0), (1, 10, 10), (2, 50, 5)}


def test_literal_walk_has_no_limit_of_rows(spark):
    tokens = spark.createDataFrame([(f, k, "length_distance" if k else "literal", [(k - 1,)] if k else []) for f in range(5) for k in range(4)], "file_id bigint, idx bigint, kind string, sources array<struct<token_index:bigint>>")
    starts = tokens.selectExpr("file_id", "idx as request", "idx as token_index")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = Q.literal_walk(tokens, starts).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert len(got) == 20 and all((r["status"], r["literal_token"], r["depth"], list(r["path"])) == ("ready", 0, r["request"], list(range(r["request"], -1, -1))) for r in got)


def test_blocks_are_found_as_the_decoder_finds_them():
    import zlib

    from glyphlake.functions import deflate, replay

    r = random.Random(4)
    for level, strategy in ((0, 0), (1, 0), (6, 0), (6, zlib.Z_HUFFMAN_ONLY), (6, zlib.Z_RLE), (6, zlib.Z_FIXED)):
        c = zlib.compressobj(level, zlib.DEFLATED, 15, 1, strategy)
        stream = b"".join(c.compress(bytes(r.choices(b"abcdefgh", [30, 20, 10, 5, 3, 2, 1, 1], k=9000))) + c.flush(zlib.Z_PARTIAL_FLUSH) for _ in range(6)) + c.flush()
        t = deflate.trace(stream, 1 << 20, False)
        begins, data = deflate.borders(stream, 1 << 20)
        assert t.success and data == t.data and begins == [(b["input_bit_begin"], b["output_begin"]) for b in t.blocks]
        for b in t.blocks[1::3]:
            at = b["output_begin"]
            assert replay.replay(stream, b["input_bit_begin"], bytes(data[max(0, at - 32768) : at]), 7000) == (bytes(data[at : at + 7000]), "")
        assert deflate.borders(stream[:-5], 1 << 20) is None and deflate.borders(stream, len(data) - 1) is None


def test_indexing_and_extracting_a_large_file_takes_seconds(spark):
    import time

    raw = bytes(random.Random(2).choices(b"abcdefghijklmnop", range(1, 17), k=1_000_000)) * 8
    files = spark.createDataFrame([(1, bytearray(E.zlib_stream(raw, 1)))], "file_id bigint, stream binary")
    wanted = ", ".join(f"named_struct('request', {k}L, 'offset', {o}L, 'length', 5000L, 'source', stream)" for k, o in enumerate((0, 7_000_001, len(raw) - 5000, len(raw) - 4999)))
    files = files.selectExpr("*", f"array({wanted}) as requests")
    began = time.perf_counter()
    got = {r["request"]: r for r in tracing.index_and_extract(files, 1 << 20).collect()}
    assert time.perf_counter() - began < 8
    assert [bytes(got[k]["data"]) == raw[o : o + 5000] for k, o in enumerate((0, 7_000_001, len(raw) - 5000))] == [True] * 3
    assert got[3]["error"] == "output range out of bounds"
    points = tracing.access_points(files, 1 << 20)
    ranges = files.selectExpr("file_id", "inline(requests)").drop("source")
    assert {r["request"]: r for r in tracing.extract_output(points, files.drop("requests"), ranges).collect()} == got


def test_extract_checks_moves_no_stream(spark):
    from glyphlake.plans import queries

    df = queries.extract_checks(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    errors = {(r["request"], r["success"], r["error"]) for r in df.collect()}
    assert errors == {(0, True, ""), (1, False, "output range out of bounds"), (2, False, "source changed since indexing"), (3, False, "source too short for the indexed stream"), (4, False, "source too short for the access point")}


def test_extract_checks_is_one_pass(spark):
    from glyphlake.plans import queries

    plan = queries.extract_checks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_streams_are_those_of_the_index(spark):
    from glyphlake.sources import carriers as C

    for made in (C.broken(spark, "/root/testdata/sf0.001"), C.gray_texts(spark, "/root/testdata/sf0.001"), spark.createDataFrame([(1, "", 0, None), (2, "", 0, bytearray(b"\x89PNG\r\n\x1a\n"))], C.FILES)):
        want, got = ({r["file_id"]: r["m"] for r in df.select("file_id", F.md5("stream").alias("m")).collect()} for df in (structure.with_stream(structure.index_files(made)), structure.streams(made)))
        assert want and got == want


def test_what_is_asked_of_a_stream_may_be_a_function(spark):
    files = spark.createDataFrame([(1, bytearray(E.zlib_stream(bytes(range(256)) * 9)), b"k"), (2, bytearray(b""), b""), (3, None, None)], "file_id bigint, stream binary, kept binary")
    column = files.selectExpr("*", "array(named_struct('request', 7L, 'offset', 300L, 'length', 9L, 'source', coalesce(stream, X'')), named_struct('request', 8L, 'offset', -1L, 'length', 1L, 'source', X'78')) as requests")

    def ask(stream):
        return [{"request": 7, "offset": 300, "length": 9, "source": stream}, {"request": 8, "offset": -1, "length": 1, "source": b"x"}]

    for kept in (None, "kept"):
        want, got = (sorted(map(tuple, df.collect())) for df in (tracing.index_and_extract(column.where("file_id < 3"), 20000, kept=kept), tracing.index_and_extract(files.where("file_id < 3"), 20000, kept=kept, ask=ask)))
        assert got == want and got[0][2] and got[0][4] == bytes(range(44, 53))
    assert tracing.index_and_extract(files, 20000, ask=ask).count() == 6


def test_large_tables_come_in_several_pieces_a_core(spark, tmp_path):
    from glyphlake.sources import carriers as C

    cores, key = spark.sparkContext.defaultParallelism, "spark.sql.files.openCostInBytes"
    spark.range(40 * cores).selectExpr("id", "cast(id as string) as text").repartition(8 * cores).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        assert C._read(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= 3 * cores
    finally:
        spark.conf.set(key, before)


def test_filters_of_many_rows_are_those_of_single_rows():
    import numpy as np

    r = np.random.default_rng(1)
    for height, width, bpp in ((1, 1, 1), (4, 3, 6), (7, 16, 1), (23, 12, 3)):
        rows = r.choice(np.array([0, 1, 127, 128, 254, 255], np.uint8), (height, width))
        above = [bytes(width), *map(bytes, rows)]
        assert E.filter_rows(rows, bpp, True, 2) == b"".join(E.filter_row((2 + k) % 5, bytes(x), above[k], bpp) for k, x in enumerate(rows))
