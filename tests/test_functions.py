"""Raster and Deflate functions against an independent encoder, zlib and known values."""

import os
import random
import zlib

import numpy as np
import pytest

from glyphlake.functions import deflate, raster
from glyphlake.functions.replay import replay
from glyphlake.operators.structure import walk
from glyphlake.sources import encode as E


def stream_of(data):
    _, chunks, _ = walk(data)
    return b"".join(data[c["data_offset"] : c["data_offset"] + c["data_length"]] for c in chunks if c["type"] == b"IDAT")


@pytest.mark.parametrize("depth,color", E.LEGAL_PAIRS)
def test_every_format_round_trips(depth, color):
    for w, h in ((1, 1), (3, 5), (8, 8), (16, 12), (31, 17)):
        for lace in (False, True):
            for rotating in (False, True):
                data, samples = E.image(w, h, depth, color, lace, rotating, split=37)
                s = raster.analyze(stream_of(data), w, h, depth, color, lace)
                assert s.success and (s.samples == samples).all()
                assert s.unfiltered == b"".join(E.pack_rows(samples.reshape(h, -1), depth))


def test_filter_values():
    x, a, b, c = 10, 5, 7, 3
    assert [(x + raster.predict(k, a, b, c)) & 255 for k in range(5)] == [10, 15, 17, 16, 17]
    assert raster.unfilter(1, bytes([10, 20, 30]), bytes(3), 1) == bytes([10, 30, 60])
    assert (200 + raster.predict(1, 100, 0, 0)) & 255 == 44
    assert (1 + raster.predict(3, 0, 255, 0)) & 255 == 128


def test_filters_invert_random_rows():
    r = random.Random(42)
    for bpp in (1, 2, 3, 4, 6, 8):
        for kind in range(5):
            for _ in range(40):
                n = bpp * r.randint(1, 9)
                row, above = r.randbytes(n), r.randbytes(n)
                assert raster.unfilter(kind, E.filter_row(kind, row, above, bpp)[1:], above, bpp) == row


def test_tokens_give_what_zlib_gives():
    r = random.Random(1)
    for k in range(20):
        raw = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 2000))) if k % 2 else os.urandom(r.randint(0, 1500))
        for level in (0, 1, 6, 9):
            for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FIXED, zlib.Z_HUFFMAN_ONLY):
                t = deflate.trace(E.zlib_stream(raw, level, strategy), 1 << 20)
                assert t.success and bytes(t.data) == raw
                light = deflate.trace(E.zlib_stream(raw, level, strategy), 1 << 20, False)
                assert (light.success, light.data, light.blocks, light.tables) == (True, t.data, t.blocks, t.tables)
                at = 0
                for k2 in t.tokens:
                    assert k2.output_begin == at
                    at = k2.output_end
                    assert all(t.tokens[s["token_index"]].kind == "literal" for s in k2.sources)
                assert at == len(raw)


def test_empty_stored_stream_is_one_end():
    t = deflate.trace(E.stored_stream(b""), 10)
    assert [k.kind for k in t.tokens] == ["end_of_block"]


def test_a_run_holds_the_longest_match():
    t = deflate.trace(E.zlib_stream(b"z" * 200_000, 6, zlib.Z_FIXED), 1 << 20)
    assert any(k.length == 258 and k.distance == 1 for k in t.tokens)


def test_caps_and_damage_are_values():
    good = E.zlib_stream(b"abcabcabc" * 50)
    assert deflate.trace(good, 10).error == "output cap exceeded"
    assert deflate.trace(b"x", 10).error == "stream too short for a zlib header"
    r = random.Random(3)
    for _ in range(500):
        b = bytearray(good)
        b[r.randrange(len(b))] ^= 1 << r.randrange(8)
        t = deflate.trace(bytes(b), 5000)
        assert t.success or t.error
        light = deflate.trace(bytes(b), 5000, False)
        assert (light.success, light.error) == (t.success, t.error)
        raster.inflate(bytes(b), 5000)
    for _ in range(300):
        b = r.randbytes(r.randint(0, 400))
        walk(b)
        walk(E.SIGNATURE + b)
        raster.analyze(b, 3, 3, 8, 2, False)
        deflate.trace(b, 1000)


def test_replay_from_every_block():
    raw = b"".join(bytes([i & 255]) * (i % 7 + 1) for i in range(30_000))
    c = zlib.compressobj(6)
    stream = b"".join(c.compress(raw[i : i + 5000]) + c.flush(zlib.Z_BLOCK) for i in range(0, len(raw), 5000)) + c.flush()
    t = deflate.trace(stream, 1 << 20)
    assert len(t.blocks) > 5 and any(b["input_bit_begin"] % 8 for b in t.blocks)
    for b in t.blocks:
        at = b["output_begin"]
        data, error = replay(stream, b["input_bit_begin"], raw[max(0, at - 32768) : at], min(700, len(raw) - at))
        assert not error and data == raw[at : at + 700]


def test_layout_values():
    p = raster.layout(4, 4, 8, 6, False)
    assert (p[0]["row_bytes"], p[0]["filter_row_bytes"], p[0]["total_bytes"]) == (16, 17, 68)
    assert raster.layout(0, 4, 8, 6, False) is None and raster.layout(4, 4, 3, 6, False) is None and raster.layout(4, 4, 8, 5, False) is None
    assert [q["width"] * q["height"] for q in raster.layout(1, 1, 8, 0, True)] == [1, 0, 0, 0, 0, 0, 0]


def test_chunk_walk_cases():
    clean = E.png(E.ihdr(1, 1, 8, 6), b"\x78\x9c" + b"\x11" * 6)
    valid, chunks, issues = walk(clean)
    assert valid and len(clean) == 65 and [c["header_offset"] for c in chunks] == [8, 33, 53] and not issues
    assert walk(clean + b"abc")[2] == [{"kind": "trailing_bytes_after_iend", "offset": 65}]
    assert walk(E.SIGNATURE + b"abc")[2] == [{"kind": "truncated_header", "offset": 8}]
    assert walk(b"\x89PN")[2] == [{"kind": "truncated_signature", "offset": 3}]
    assert walk(clean[:30])[2] == [{"kind": "truncated_crc", "offset": 29}]
    assert walk(clean[:20])[2] == [{"kind": "truncated_data", "offset": 16}]
    assert walk(clean[:33]) [2] == []
    assert np.frombuffer(chunks[0]["type"], np.uint8).tolist() == [73, 72, 68, 82]


def test_steps_file_by_file_share_a_worker_and_bound_batches(spark):
    from glyphlake.functions import perfile

    def parts(k, n):
        for i in range(n):
            yield k, i, bytes(300_000)

    def sizes(i, data):
        yield i, len(data), [i] * 3

    once = perfile.per_file(spark.createDataFrame([(1, 40), (2, 3)], "k bigint, n bigint"), "k bigint, i bigint, data binary", parts, "k", "n")
    twice = perfile.per_file(once, "i bigint, size bigint, l array<bigint>", sizes, "i", "data")
    assert twice._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["i"], r["size"], r["l"]) for r in twice.collect()) == sorted((i, 300_000, [i] * 3) for n in (40, 3) for i in range(n))
    assert sorted(map(tuple, once.selectExpr("k", "i", "octet_length(data)").collect())) == sorted((k, i, 300_000) for k, n in ((1, 40), (2, 3)) for i in range(n))
